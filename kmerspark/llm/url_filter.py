"""URL allow and block lists: a trie over reversed host labels, then path segments.

An entry is a host (``example.com`` holds for it and all hosts below it) and optionally
leading path segments (``example.com/ads``). The most specific entry that matches a URL
decides: the one with more host labels, then the one with more path segments; if the same
entry is in both lists, block wins. A URL that no entry matches gets the default action.

The trie is broadcast while the entries are few enough (``TRIE_ENTRIES``); longer lists are
joined instead: each URL lists the keys that could match it, at most labels x segments,
and the best one found in the list wins, with the same result.

A host is lower-cased, without user, port and closing dot; an IP address (IPv6 in brackets) is
one label, so an entry holds for it only as a whole. The path ends at ``?`` or ``#``, and empty
segments are left out. Defined results: a null, empty or unreadable URL (no
``scheme://host``) has no host and gets the action ``invalid``. Repeated rows are
classified alike. An empty list gives every readable URL the default action; null entries, and
actions other than ``allow`` and ``block``, are ignored. Urls of any length are read whole. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_ACTION = "allow"
TRIE_ENTRIES = 1_000_000
#: Sample production lists: spam hosts, with one allowed host and section below blocked ones.
RULES: tuple[tuple[str, str], ...] = (
    ("spam-farm.example.org", "block"),
    ("cheap-pills.example.com", "block"),
    ("example.net", "block"),
    ("ththin.example.net", "allow"),
    ("blog.ththin.example.net", "block"),
    ("tionsh.example.net/es", "allow"),
    ("blog.tionble.example.com/de", "block"),
    ("blog.tionble.example.com/de/7", "allow"),
    ("m.ththth.example.com/fr", "block"),
    ("example.com/es", "block"),
    ("example.org/en/25", "block"),
    ("www.example.org", "block"),
)


def host_labels(host: str) -> list[str]:
    """Reversed labels; an IP address is one."""
    if host.startswith("[") or (host.count(".") == 3 and host.replace(".", "").isdigit()):
        return [host]
    return [x for x in host.split(".") if x][::-1]


def split_entry(entry: str) -> tuple[list[str], list[str]]:
    """Reversed host labels and path segments of a list entry."""
    host, _, path = entry.strip().partition("/")
    return host_labels(host.lower().strip(".")), [x for x in path.split("/") if x]


def split_url(url: str | None) -> tuple[list[str], list[str]] | None:
    """Reversed host labels and path segments of a URL; None if it has no host."""
    if not url:
        return None
    scheme, mark, rest = url.partition("://")
    if not mark or not scheme or not (scheme[0].isascii() and scheme[0].isalpha()) or not all(c.isascii() and (c.isalnum() or c in "+.-") for c in scheme):
        return None
    for stop in "?#":
        rest = rest.partition(stop)[0]
    authority, _, path = rest.partition("/")
    host = authority.rpartition("@")[2].lower()
    if host.startswith("["):
        host = host.partition("]")[0] + "]" if "]" in host else ""
    else:
        host = host.partition(":")[0].strip(".")
    if not host:
        return None
    return host_labels(host), [x for x in path.split("/") if x]


class Trie:
    """Nodes are (host children, path children, action); the path hangs below its host."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.root: list = [{}, {}, None, None]
        for entry, action in rules:
            if entry is None or action not in ("allow", "block"):
                continue
            labels, segments = split_entry(entry)
            if not labels:
                continue
            node = self.root
            for label in labels:
                node = node[0].setdefault(label, [{}, {}, None, None])
            for segment in segments:
                node = node[1].setdefault(segment, [{}, {}, None, None])
            if node[2] != "block":
                node[2], node[3] = action, key_of(labels, segments)

    def match(self, labels: list[str], segments: list[str]) -> tuple[str | None, str | None]:
        """The action and key of the most specific entry."""
        hosts, node = [], self.root
        for label in labels:
            node = node[0].get(label)
            if node is None:
                break
            hosts.append(node)
        for node in reversed(hosts):
            best = node if node[2] else None
            for segment in segments:
                node = node[1].get(segment)
                if node is None:
                    break
                if node[2]:
                    best = node
            if best:
                return best[2], best[3]
        return None, None


def key_of(labels: list[str], segments: list[str]) -> str:
    return "/".join([".".join(labels[::-1]), *segments])


#: The tries that a Python worker has built, by the list they belong to; the last few only.
_BUILT: dict[str, Trie] = {}


def _trie(name: str, rules: list[tuple[str, str]]) -> Trie:
    """The trie of a broadcast list, built once in each Python worker."""
    if name not in _BUILT:
        while len(_BUILT) > 3:
            _BUILT.pop(next(iter(_BUILT)))
        _BUILT[name] = Trie(rules)
    return _BUILT[name]


def _with_trie(pages: DataFrame, rules: list[tuple[str, str]], default: str) -> DataFrame:
    shared, name = pages.sparkSession.sparkContext.broadcast(rules), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(name, shared.value)
        for batch in batches:
            actions, keys = [], []
            for url in batch.column("url").to_pylist():
                parts = split_url(url)
                action, key = trie.match(*parts) if parts else ("invalid", None)
                actions.append(action or default)
                keys.append(key)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(actions, pa.string()), pa.array(keys, pa.string())], names=["page_id", "url", "action", "rule"])

    return pages.select(F.col("page_id").cast("bigint"), "url").mapInArrow(run, "page_id bigint, url string, action string, rule string")


def _with_join(pages: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same by an equality join on every key that could match."""

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid, keys = [], []
            for url in batch.column("url").to_pylist():
                parts = split_url(url)
                valid.append(parts is not None)
                own = []
                if parts:
                    labels, segments = parts
                    # most specific first: more labels, then more segments
                    own = [key_of(labels[:i], segments[:j]) for i in range(len(labels), 0, -1) for j in range(len(segments), -1, -1)]
                keys.append(own)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(valid), pa.array(keys, pa.list_(pa.string()))], names=["page_id", "url", "valid", "keys"])

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(key_of(*split_entry(e)), a) for e, a in zip(batch.column("entry").to_pylist(), batch.column("action").to_pylist()) if e is not None and a in ("allow", "block") and split_entry(e)[0]]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([a for _, a in rows], pa.string())], names=["rule", "found"])

    wide = pages.select(F.col("page_id").cast("bigint"), "url").mapInArrow(keys_of, "page_id bigint, url string, valid boolean, keys array<string>")
    urls = wide.select("url", "valid", "keys").dropDuplicates(["url"])
    listed = rules.mapInArrow(entries, "rule string, found string").groupBy("rule").agg(F.min_by("found", F.col("found") != "block").alias("found"))
    each = urls.select("url", F.posexplode("keys").alias("at", "rule")).join(listed, "rule")
    first = Window.partitionBy("url").orderBy("at")
    best = each.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(F.col("url").alias("_url"), "rule", "found")
    action = F.when(~F.col("valid"), F.lit("invalid")).otherwise(F.coalesce("found", F.lit(default)))
    return wide.join(best, F.col("url") == F.col("_url"), "left").select("page_id", "url", action.alias("action"), "rule")


def classify(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_ACTION, trie_entries: int = TRIE_ENTRIES) -> DataFrame:
    """(page_id, url, action, rule): the deciding entry of every page; ``rules`` has (entry, action)."""
    listed = rules.select(F.col("entry").cast("string"), F.col("action").cast("string"))
    if listed.count() > trie_entries:
        return _with_join(pages, listed, default)
    return _with_trie(pages, [(r["entry"], r["action"]) for r in listed.collect()], default)


def rules_frame(spark, rules: Iterable[tuple[str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "entry string, action string")


def _oracle() -> str:
    values = ", ".join(f"('{'.'.join(split_entry(e)[0][::-1])}', {split_entry(e)[1]!r}::VARCHAR[], '{a}')" for e, a in RULES)
    return f"""
WITH rules AS (SELECT host, segs, action, len(string_split(host, '.')) AS labels FROM (VALUES {values}) AS t(host, segs, action)),
parsed AS (SELECT page_id, url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1) AS authority, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*(/[^?#]*)?', 1) AS path FROM pages),
named AS (SELECT *, lower(regexp_replace(authority, '^.*@', '')) AS name FROM parsed),
hosts AS (SELECT page_id, url, CASE WHEN starts_with(name, '[') THEN regexp_extract(name, '^\\[[^\\]]*\\]') ELSE regexp_replace(regexp_replace(name, ':.*$', ''), '^[.]+|[.]+$', '', 'g') END AS host, list_filter(string_split(coalesce(path, ''), '/'), lambda s: s <> '') AS segs FROM named),
hits AS (SELECT p.page_id, p.url, r.action, array_to_string(list_concat([r.host], r.segs), '/') AS rule, row_number() OVER (PARTITION BY p.page_id, p.url ORDER BY r.labels DESC, len(r.segs) DESC, r.action DESC) AS n
 FROM hosts p JOIN rules r ON (p.host = r.host OR suffix(p.host, '.' || r.host) AND NOT regexp_matches(p.host, '^\\[|^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$')) AND list_slice(p.segs, 1, len(r.segs)) = r.segs)
SELECT h.page_id, h.url, CASE WHEN h.host = '' OR h.host IS NULL THEN 'invalid' ELSE coalesce(x.action, '{DEFAULT_ACTION}') END AS action, x.rule
FROM hosts h LEFT JOIN (SELECT * FROM hits WHERE n = 1) x ON h.page_id = x.page_id AND h.url = x.url
"""


ORACLE = _oracle()
