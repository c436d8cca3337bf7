"""Personal data replaced by keyed surrogates of the same type and format.

Detected: e-mail addresses, telephone numbers (international ones in any groups; national ones
of three parts, of groups of two digits, or of an area with its 0 and a number), IPv4 and IPv6
addresses (whole or with ``::``), payment cards (groups of four, or 4-6-5 and 4-6-4), IBANs,
national identifiers (ddd-dd-dddd), other long digit runs, secrets (``token = "..."``,
``password=...``, ``Bearer ...``, cloud access keys, private-key blocks) and names of
persons after a title or made of a known given name and a family name.

Every replacement is a keyed permutation of all strings of its format, so equal entities get
equal surrogates in every document (coreference), different ones get different surrogates
(distinctness), and no table of entities has to be gathered or shuffled: the result does not
depend on partitioning, and a lost task computes the same again. A digit becomes a digit, a
letter a letter of the same case, kind (vowel or consonant) and script, and punctuation
stays, so a surrogate is of its entity's type. Known given names are permuted within their
gender and script; other name parts are permuted letter-wise. The permutations have no
fixed point, so an entity is never its own surrogate. Where a permuted value would leave its
format (an IPv4 part over 255, a card whose checksum fails, a reserved given name), the
permutation is walked until it is in the format again, which keeps it one-to-one.

``collisions`` counts what the scheme rules out - two entities with one surrogate, two
surrogates of one entity - over all entities of a corpus; ``entities`` lists them. A
permutation keeps the entities of one type apart. Inside a document it is also checked that
no two entities of different types have one surrogate; the later one is walked on then, in
that document alone, which is the only exception to coreference.

Names are found after a title (in any script with capitals, or Chinese characters), or as a
known given name with a family name behind it; a name of unknown words without a title is not
found. The case of a hexadecimal secret counts, that of an IPv6 address does not. An IBAN whose
check digits are right gets a surrogate whose check digits are right.

Defined results: null text stays null, empty text empty, and a text of any length is read
whole. Overlapping matches go to the type first in ``TYPES``, then to the longer one. Names
differing only in case share a surrogate up to case. Repeated rows change alike, each on its
own, so ties do not matter. An empty table stays empty. Other columns are passed through; where
one has the name asked for the count, the count's name gets underscores.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerspark.llm.text import trimmed
from kmerspark.operators.prefix import fresh_name

DEFAULT_KEY = b"surrogate-key-v1"
TYPES = ("private_key", "secret", "email", "iban", "card", "ssn", "phone", "ipv6", "ipv4", "number", "person")

_GIVEN = {
    ("f", "latin"): "Anna Maria Elena Sofia Laura Julia Clara Emma Alice Marie Camille Claire Louise Chloe Sarah Emily Mary Jane Susan Linda Karen Nancy Lisa Margaret Carmen Isabel Lucia Pilar Teresa Ingrid Heidi Ursula Petra Greta Hannah Lena Priya Aisha Fatima Yuki Leila".split(),
    ("m", "latin"): "John Peter Paul Thomas Michael David James Robert William Richard Charles Joseph Daniel Mark George Jean Pierre Jacques Louis Antoine Carlos Juan Luis Miguel Pedro Javier Diego Hans Karl Klaus Jürgen Stefan Wolfgang Dieter Otto Fritz Rahul Ahmed Mohammed Hiroshi Omar".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Татьяна Наталья Ирина Светлана Екатерина Юлия".split(),
    ("m", "cyrillic"): "Иван Пётр Алексей Дмитрий Сергей Андрей Николай Михаил Владимир Павел".split(),
    ("f", "greek"): "Μαρία Ελένη Κατερίνα Σοφία Άννα Δήμητρα".split(),
    ("m", "greek"): "Γιώργος Νίκος Κώστας Δημήτρης Παύλος Αλέξανδρος".split(),
}
_KNOWN = {name: group for group, names in _GIVEN.items() for name in names}
_TITLES = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Mlle|Señor|Señora|Sr|Sra|Don|Doña|г-н|г-жа|κ)"
_NAME_REST = r"[\w'’\-]*[^\W\d_]"
def _ranges(good) -> str:
    """The characters below U+2000 that are good, as the inside of a bracket expression."""
    codes = [c for c in range(0x41, 0x2000) if good(chr(c))]
    starts = [c for c in codes if c - 1 not in codes]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, (c for c in codes if c + 1 not in codes)))


_CAPITAL = f"[{_ranges(str.isupper)}]"
_HAN = "[\u4e00-\u9fff]"

_PATTERNS = {
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----",
    "secret": r"(?i:\b(?:api[_-]?key|access[_-]?key|secret|token|passwd|password|pwd|auth)\b[\"']?\s*[:=]\s*[\"']?)(?P<v1>[A-Za-z0-9+/_\-.~]{6,}=*)|\b(?i:bearer)\s+(?P<v2>[A-Za-z0-9+/_\-.~]{16,}=*)|\b(?P<v3>(?:AKIA|ASIA|AIza|ghp_|gho_|sk-|xox[abp]-)[A-Za-z0-9_\-]{12,})|\b(?P<v4>(?=[0-9a-fA-F]*[0-9])(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]{32,})\b",
    "email": r"[\w][\w.+\-]{0,63}@(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,24}\b",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"(?<![0-9.\-])(?:(?:[0-9]{4}[ \-]?){3}[0-9]{1,7}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{4,5})(?![0-9\-])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "phone": r"(?<![\w.])(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{1,4}\)[ .\-]?|[0-9]{2,4}[ .\-])[0-9]{3,4}[ .\-][0-9]{3,4}(?!\w)|(?<!\w)\+[0-9]{8,15}(?!\w)"
    # international in any groups, 8 to 15 digits
    r"|(?<![\w.])(?:\+|00(?=[0-9]{1,3}[ .\-]))[1-9](?:(?:[ .\-]?\(?|\)[ .\-]?)[0-9]){7,14}(?!\w|[.\-][0-9])"
    # national: 06 12 34 56 78, 089 12 34 56 78; 612 34 56 78, 91 234 56 78; 030 1234567, (030) 1234567, 06021 12345
    r"|(?<![\w.])(?:0[1-9][0-9]{0,3}(?:(?: [0-9]{2}){4}|(?:\.[0-9]{2}){4}|(?:-[0-9]{2}){4})|[6-9](?:[0-9] [0-9]{3}|[0-9]{2} [0-9]{2})(?: [0-9]{2}){2}|[6-9](?:[0-9]-[0-9]{3}|[0-9]{2}-[0-9]{2})(?:-[0-9]{2}){2})(?!\w|[.\-][0-9])"
    r"|(?<![\w./])(?:0[1-9][0-9]{0,3}[ /\-][0-9]{6,8}|0[1-9][0-9]{2,3}[ /\-][0-9]{5}|\(0[1-9][0-9]{0,3}\) ?[0-9]{5,8})(?!\w|[./\-][0-9])",
    "ipv6": r"(?<![\w:])(?:(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|(?:[0-9A-Fa-f]{1,4}:){2,7}:|:(?::[0-9A-Fa-f]{1,4}){2,7})(?![\w:]|\.[0-9])",
    "ipv4": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9])(?!\.[0-9])",
    "number": r"(?<![\w.])[0-9]{8,19}(?![\w])",
    "person": rf"\b{_TITLES}\.?[ ](?P<p1>{_CAPITAL}{_NAME_REST}(?:[ ]{_CAPITAL}{_NAME_REST}){{0,2}}|{_HAN}{{2,4}}(?!{_HAN}))|\b(?P<p2>(?:{'|'.join(_KNOWN)})[ ]{_CAPITAL}{_NAME_REST})\b",
}
_COMPILED = {kind: re.compile(_PATTERNS[kind]) for kind in TYPES}
#: What a text must contain for the patterns of each type to be tried at all.
_NEEDS = {
    "private_key": re.compile("PRIVATE KEY"),
    "secret": re.compile(r"[0-9a-fA-F]{32}|(?i:key|token|secret|passw|pwd|auth|bearer)|AKIA|ASIA|AIza|gh[op]_|sk-|xox"),
    "email": re.compile("@"),
    "iban": re.compile(r"[A-Z]{2}[0-9]{2}"),
    "card": re.compile(r"[0-9]{4}[ \-]?[0-9]{4}[ \-]?[0-9]{4}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{4}"),
    "ssn": re.compile(r"[0-9]-[0-9]{2}-[0-9]{4}"),
    "phone": re.compile(r"[0-9]{3}[ .\-][0-9]{3}|\+[0-9]|00[1-9][0-9]{0,2}[ .\-]|[0-9][ .\-][0-9]{2}[ .\-][0-9]{2}|0[1-9][0-9]{0,3}(?:[ /\-]|\) ?)[0-9]{5}"),
    "ipv6": re.compile(r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f:]|::[0-9A-Fa-f]"),
    "ipv4": re.compile(r"[0-9]\.[0-9]{1,3}\.[0-9]"),
    "number": re.compile("[0-9]{8}"),
}
_WORDS = "|".join([_TITLES[3:-1], *_KNOWN])
_NEEDS["person"] = re.compile(rf"\b(?:{_WORDS})\b")
#: The same needs for a whole column in one linear pass; texts without a hit are left alone.
_COLUMN_NEEDS = r"[0-9]{8}|[0-9a-fA-F]{32}|@|PRIVATE KEY|[0-9][ .:\-][0-9(]|[0-9a-fA-F]:[0-9A-Fa-f]{1,4}:|::[0-9a-fA-F]|[0-9]/[0-9]{5}|(?i:key|token|secret|passw|pwd|auth|bearer)|AKIA|ASIA|AIza|gh[op]_|sk-|xox|[A-Z]{2}[0-9]{2}|\+[0-9]|\) ?[0-9]"
_COLUMN_NAMES = rf"(?:^|[^\pL\pN_])(?:{_WORDS})(?:[^\pL\pN_]|$)"

_CLASSES = ["0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "àáâãäåæèéêëìíîïòóôõöøùúûü", "çðñþß", "ÀÁÂÃÄÅÆÈÉÊËÌÍÎÏÒÓÔÕÖØÙÚÛÜ", "ÇÐÑÞ", "аеиоуыэюяё", "бвгджзйклмнпрстфхцчшщ", "АЕИОУЫЭЮЯЁ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ"]
# further Latin letters by case, and Chinese characters
_CLASSES += ["".join(chr(c) for c in range(0x100, 0x180) if chr(c).islower()), "".join(chr(c) for c in range(0x100, 0x180) if chr(c).isupper()), "".join(map(chr, range(0x4E00, 0xA000)))]
_MIXED = dict.fromkeys("0123456789abcdefABCDEF", "0123456789abcdefABCDEF")
_LOWER, _UPPER = (dict.fromkeys(a, a) for a in ("0123456789abcdef", "0123456789ABCDEF"))
_CLASS = {c: alphabet for alphabet in _CLASSES for c in alphabet}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_check(text: str) -> str:
    """The check digits that an account number needs (98 less the rest modulo 97)."""
    plain = text.replace(" ", "")
    return f"{98 - int(''.join(str(int(c, 36)) for c in plain[4:] + plain[:2] + '00')) % 97:02d}"


def _is_ipv6(text: str) -> bool:
    """Whether a match of the pattern is an address: names in code are joined by ``::`` too."""
    groups = [g for g in text.split(":") if g]
    return "::" not in text or len(groups) < 8 and (len(groups) > 2 or any(c.isdigit() for c in text))


class Surrogates:
    """Keyed format-preserving permutations without fixed points, one family per type."""

    def __init__(self, key: bytes = DEFAULT_KEY):
        self.key = key
        self.memo: dict[tuple[str, str], str] = {}
        self.rings = {group: sorted(names, key=lambda v: hmac.digest(key, v.encode(), "sha256")) for group, names in _GIVEN.items()}

    def _round(self, tweak: str, i: int, value: int, size: int) -> int:
        text = f"{tweak}|{i}|{value}".encode()
        return int.from_bytes(hashlib.blake2b(text, digest_size=16, key=self.key[:64]).digest(), "big") % size

    def _feistel(self, value: int, size: int, tweak: str, back: bool = False) -> int:
        """A permutation of 0..size-1: an unbalanced Feistel network over a x b >= size."""
        a = 1
        while a * a < size:
            a += 1 if size < 4096 else max(1, a // 2)
        if size >= 4096:
            a = int(np.ceil(np.sqrt(float(size)))) if size < 2**50 else 1 << ((size.bit_length() + 1) // 2)
        b = -(-size // a)
        while True:
            left, right = divmod(value, b)  # left < a, right < b
            for i in (3, 2, 1, 0) if back else (0, 1, 2, 3):
                sign = -1 if back else 1
                if i % 2 == 0:
                    left = (left + sign * self._round(tweak, i, right, a)) % a
                else:
                    right = (right + sign * self._round(tweak, i, left, b)) % b
            value = left * b + right
            if value < size:
                return value

    def _cycle(self, value: int, size: int, tweak: str) -> int:
        """A keyed permutation that is one single cycle, and so has no fixed point."""
        if size == 1:
            return value
        return self._feistel((self._feistel(value, size, tweak, back=True) + 1) % size, size, tweak)

    def permute(self, text: str, tweak: str, alphabets: dict[str, str] = _CLASS) -> str:
        """Permute the strings of this text's format: position by position the same classes."""
        used = [alphabets.get(c) for c in text]
        value, size = 0, 1
        for c, alphabet in zip(text, used):
            if alphabet:
                value, size = value * len(alphabet) + alphabet.index(c), size * len(alphabet)
        form = "".join(alphabet[0] if alphabet else c for c, alphabet in zip(text, used))
        value = self._cycle(value, size, f"{tweak}|{form}")
        out = []
        for c, alphabet in zip(reversed(text), reversed(used)):
            if alphabet:
                value, digit = divmod(value, len(alphabet))
                c = alphabet[digit]
            out.append(c)
        return "".join(reversed(out))

    def _walk(self, text: str, tweak: str, good, alphabets: dict[str, str] = _CLASS) -> str:
        """Permute until ``good``; one-to-one on the texts that are good."""
        out = self.permute(text, tweak, alphabets)
        while not good(out):
            out = self.permute(out, tweak, alphabets)
        return out

    def _given(self, word: str) -> str:
        """A given name of the same gender and script, or a permuted unknown word."""
        plain = word.capitalize()
        group = _KNOWN.get(plain)
        if group:
            ring = self.rings[group]
            other = ring[(ring.index(plain) + 1) % len(ring)]
            return other.upper() if word.isupper() and len(word) > 1 else other.lower() if word.islower() else other
        return self._walk(word, "name", lambda v: v.capitalize() not in _KNOWN)

    def _make(self, kind: str, text: str) -> str:
        if kind == "person":
            return re.sub(r"[^\s\-]+", lambda m: self._given(m[0]), text)
        if kind == "email":
            local, _, domain = text.rpartition("@")
            host, _, suffix = domain.rpartition(".")
            # the host is permuted on its own, so that one provider stays one provider
            return f"{self.permute(local, 'email')}@{self.permute(host, 'host')}.{suffix}"
        if kind == "ipv4":
            def good(v: str) -> bool:
                return all(int(p) < 256 and (len(p) == 1 or p[0] != "0") for p in v.split("."))
            return self._walk(text, kind, good) if good(text) else self.permute(text, kind)
        if kind == "ipv6":
            if text.upper() != text and text.lower() != text:
                text = text.lower()  # mixed case names the same address
            out = self._hex(text, kind)
            while _is_ipv6(text) and not _is_ipv6(out):
                out = self._hex(out, kind)
            return out
        if kind == "card":
            digits = re.sub(r"\D", "", text)
            return self._walk(text, kind, lambda v: luhn(re.sub(r"\D", "", v))) if luhn(digits) else self._walk(text, kind, lambda v: not luhn(re.sub(r"\D", "", v)))
        if kind == "phone":
            def is_phone(v: str) -> bool:
                return _COMPILED[kind].fullmatch(v) is not None
            return self._walk(text, kind, is_phone) if is_phone(text) else self.permute(text, kind)
        if kind == "iban":
            def good(v: str) -> bool:
                return iban_check(v) == v[2:4]
            if good(text):
                new = text[:4] + self.permute(text[4:], kind)
                return new[:2] + iban_check(new) + new[4:]
            return text[:2] + self._walk(text[2:], kind, lambda v: not good(text[:2] + v))
        if kind in ("secret", "private_key"):
            head = re.match(r"(?:AKIA|ASIA|AIza|ghp_|gho_|sk-|xox[abp]-)", text)
            keep = head.end() if head else 0
            if kind == "private_key":
                lines = text.split("-----")
                return "-----".join([*lines[:2], self._long(lines[2]), *lines[3:]]) if len(lines) > 3 else self._long(text)
            rest = text[keep:]
            if all(c in _LOWER or c in _UPPER for c in rest):
                return text[:keep] + self._hex(rest, kind)
            if len(rest) > 256:
                return text[:keep] + self._long(rest)
            return text[:keep] + self._walk(rest, kind, lambda v: not all(c in _LOWER or c in _UPPER for c in v))
        return self.permute(text, kind)

    def _hex(self, text: str, tweak: str) -> str:
        """Hexadecimal strings: of small letters, of capitals, or of both, as the text is."""
        if text.lower() == text:
            return self.permute(text, tweak, _LOWER)
        if text.upper() != text:
            return self._walk(text, tweak, lambda v: v.lower() != v and v.upper() != v, _MIXED)
        return self._walk(text, tweak, lambda v: v.lower() != v, _UPPER)

    def _long(self, text: str) -> str:
        """Long secrets, in pieces that each depend on a hash of what stands before them."""
        out, state = [], b""
        for i in range(0, len(text), 64):
            piece = text[i : i + 64]
            out.append(self.permute(piece, "long|" + state.hex()))
            state = hashlib.blake2b(state + piece.encode(), digest_size=8, key=self.key[:64]).digest()
        return "".join(out)

    def surrogate(self, kind: str, text: str) -> str:
        known = self.memo.get((kind, text))
        if known is None:
            if len(self.memo) > 200_000:
                self.memo.clear()  # a cache only: any entry is computed again alike
            known = self.memo[kind, text] = self._make(kind, text)
        return known


def maybe_private(texts: pa.Array) -> list[int]:
    """The rows whose texts any pattern could match."""
    hit = pc.or_(pc.match_substring_regex(texts, _COLUMN_NEEDS), pc.match_substring_regex(texts, _COLUMN_NAMES))
    return np.flatnonzero(pc.fill_null(hit, False).to_numpy(zero_copy_only=False)).tolist()


def find_entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of the entities, in order and without overlaps."""
    found: list[tuple[int, int, str]] = []
    kinds = [kind for kind in TYPES if _NEEDS[kind].search(text)]
    taken = bytearray()
    for kind in kinds:
        for match in _COMPILED[kind].finditer(text):
            group = match.lastgroup
            start, end = match.span(group) if group else match.span()
            if kind == "iban" and not any(c.isdigit() for c in match[0][4:]):
                continue
            if kind == "ipv6" and not _is_ipv6(match[0]):
                continue
            if not taken:
                taken = bytearray(len(text))
            if any(taken[start:end]):
                continue
            taken[start:end] = b"\1" * (end - start)
            found.append((start, end, kind))
    return sorted(found)


def scrub(text: str | None, surrogates: Surrogates) -> tuple[str | None, int]:
    """The text with surrogates for its entities, and their number."""
    if not text:
        return text, 0
    found = find_entities(text)
    if not found:
        return text, 0
    chosen: dict[tuple[str, str], str] = {}
    used: dict[str, str] = {}
    for kind, value in sorted({(kind, text[a:b]) for a, b, kind in found}):
        new = first = surrogates.surrogate(kind, value)
        # one type is one permutation, so only types that write alike can meet
        while used.get(new, kind) != kind:
            new = surrogates.surrogate(kind, new)
            if new == first:
                break  # the whole format is taken
        chosen[kind, value] = new
        used.setdefault(new, kind)
    out, at = [], 0
    for a, b, kind in found:
        value = text[a:b]
        out += [text[at:a], chosen[kind, value]]
        at = b
    return "".join([*out, text[at:]]), len(found)


def replace_pii(docs: DataFrame, key: bytes = DEFAULT_KEY, count: str | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text``; ``count`` names a column for their number.

    Only the text passes through Python with whatever columns ``docs`` has; where
    ``n_chars`` is a column, it is kept in step with the text.
    """
    fields = docs.schema.fields
    if count:
        count = fresh_name(docs.columns, count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = Surrogates(key)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts: list[str] = []
            column = batch.column(at)
            changed = np.zeros(len(column), dtype=bool)
            counts = np.zeros(len(column), dtype=np.int32)
            for row in maybe_private(column):
                new, n = scrub(column[row].as_py(), surrogates)
                if n:
                    changed[row], counts[row] = True, n
                    texts.append(new)
            if texts:
                batch = batch.set_column(at, "text", pc.replace_with_mask(column, pa.array(changed), pa.array(texts, column.type)))
                size = batch.schema.get_field_index("n_chars")
                if size >= 0:
                    lengths = pa.array(list(map(len, texts)), batch.column(size).type)
                    batch = batch.set_column(size, "n_chars", pc.replace_with_mask(batch.column(size), pa.array(changed), lengths))
            if count:
                batch = pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts)], names=[*batch.schema.names, count])
            yield batch

    ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in fields)
    return docs.mapInArrow(trimmed(run), ddl + (f", `{count}` int" if count else ""))


def entities(docs: DataFrame, key: bytes = DEFAULT_KEY) -> DataFrame:
    """(type, entity, surrogate, n): every distinct entity and how often it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = Surrogates(key)
        for batch in batches:
            texts = (batch.column(0)[row].as_py() for row in maybe_private(batch.column(0)))
            rows = [(kind, text[a:b]) for text in texts for a, b, kind in find_entities(text)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([v for _, v in rows], pa.string()), pa.array([surrogates.surrogate(k, v) for k, v in rows], pa.string())], names=["type", "entity", "surrogate"])

    return docs.select("text").mapInArrow(trimmed(run), "type string, entity string, surrogate string").groupBy("type", "entity", "surrogate").agg(F.count("*").alias("n"))


def collisions(found: DataFrame) -> DataFrame:
    """(type, surrogate, entities): surrogates that stand for more than one entity."""
    return found.groupBy("type", "surrogate").agg(F.countDistinct("entity").alias("entities")).where("entities > 1")
