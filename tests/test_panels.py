import pytest

from kmerspark.sources import panels, sinks

PANEL = """
name: mine
schema_version: "2"
clade: Mollusca
primers:
- {gene: 16S, region: v4, index: 2, forward_seq: acgtacgtacgtacgt, reverse_seq: TTTTACGTACGTACGA, min_count: 1}
- {gene: old, forward_seq: ACGTACGTACGTACGT, reverse_seq: TTTTACGTACGTACGA, deprecated: true}
"""


def test_inline_takes_values_after_the_first_sign():
    pair = panels.parse_inline("Name=x,FORWARD=acgt,reverse=TTGA,max-length=500,notes=a=b")
    assert (pair["name"], pair["forward_seq"], pair["reverse_seq"], pair["max_length"], pair["trim"]) == ("x", "ACGT", "TTGA", 500, 15)


@pytest.mark.parametrize("spec", ["", "name", "name=a,NAME=b", "colour=red", "trim=ten", "trim=-1", "trim=1_0", "trim="])
def test_inline_errors(spec):
    with pytest.raises(panels.PanelError):
        panels.parse_inline(spec)


def test_panel_file_is_named_checked_and_clamped(spark, tmp_path):
    (tmp_path / "p.yaml").write_text(PANEL)
    got = panels.collect(spark, [str(tmp_path / "p.yaml")], ["name=x,forward=ACGTAA,reverse=TTGACC"], 3).orderBy("gene").collect()
    assert [(r.gene, r.forward_seq, r.min_count) for r in got] == [("mine_16S-v4_2", "ACGTACGTACGTACGT", 3), ("x", "ACGTAA", 3)]


def test_panel_by_address_is_bounded(spark):
    assert panels.collect(spark, ["https://example.org/p.yaml"], [], fetch=lambda url: PANEL.encode()).count() == 1
    with pytest.raises(panels.PanelError):
        panels.load("https://example.org/p.yaml", lambda url: b" " * (panels.MOST_BYTES + 1))


@pytest.mark.parametrize("old,new", [("clade: Mollusca\n", ""), ("16S", "16_S"), ("16S", "16-S"), ("region: v4", "region: v_4"), ("gene: old", "gene: 16S, region: v4, index: 2"), ("name: mine", "title: mine"), ("clade: Mollusca", "clade: [")])
def test_panel_errors(spark, tmp_path, old, new):
    (tmp_path / "p.yaml").write_text(PANEL.replace(old, new))
    with pytest.raises(panels.PanelError):
        panels.collect(spark, [str(tmp_path / "p.yaml")], [])


def test_names_must_differ(spark):
    with pytest.raises(panels.PanelError):
        panels.collect(spark, [], ["name=x,forward=AC,reverse=GT"] * 2)
    with pytest.raises(panels.PanelError):
        panels.collect(spark, ["nothing"], [])


def test_export_loads_as_what_it_was(spark, tmp_path):
    (tmp_path / "human.yaml").write_text(panels.export("human"))
    again = panels.collect(spark, [str(tmp_path / "human.yaml")], [])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, panels.collect(spark, ["human"], []).collect()))
    assert panels.listing(spark).count() == 9


def test_sample_names():
    assert panels.sample_name(None, "R1", "Homo sapiens") == "Homo_sapiens_R1"
    assert panels.sample_name("a.b-c") == "a.b-c"
    for bad in (None, "a/b", "a b"):
        with pytest.raises(panels.PanelError):
            panels.sample_name(bad)


def test_fasta_files_by_gene(spark, tmp_path):
    rows = [("a", 0, "A" * 81, 81, 2.0, 1.5), ("a", 1, "C" * 80, 80, 2.0, 1.5), ("b", 0, "G", 1, 2.0, 1.5)]
    folder = str(tmp_path / "out")
    sinks.write_fasta(spark.createDataFrame(rows, "gene string, product int, seq string, length int, median double, score double"), folder, "s")
    files = {p.parent.name: p.read_text() for p in (tmp_path / "out").glob("gene=*/part-*")}
    assert files["gene=b"] == ">s_b_0 product=0 length=1 kmer_count_median=2.00 score=1.5000\nG\n"
    assert files["gene=a"].split("\n")[1:3] == ["A" * 80, "A"]
    assert sorted(map(tuple, sinks.read_fasta_files(spark, folder).collect())) == [("a", "s_a_0", "A" * 81), ("a", "s_a_1", "C" * 80), ("b", "s_b_0", "G")]


def test_histograms_and_summary(spark, tmp_path, caplog):
    rows = spark.createDataFrame([(2, 0, 1), (1, 5, 6)], "count int, chunk_1 int, chunk_2 int")
    paths = sinks.write_histograms(rows, str(tmp_path / "s"))
    assert (tmp_path / "s.final.histo").read_text() == "# k-mer counts\ncount\tchunk_2\n1\t6\n2\t1\n"
    assert sorted(map(tuple, sinks.read_histogram(spark, paths[0]).collect())) == [(1, 5, 6), (2, 0, 1)]
    (tmp_path / "old.histo").write_text("1\t5\n2\t7\n")
    assert sorted(map(tuple, sinks.read_histogram(spark, str(tmp_path / "old.histo"), 1).collect())) == [(1, 5), (2, 7)]
    results = spark.createDataFrame([("a", "ok", 1, [30], None), ("b", "failed", 0, [], "no path found")], "gene string, status string, n_products int, product_lengths array<int>, reason string")
    text = sinks.stats_yaml({"k": 19, "sample": "s: 1"}, results)
    yaml = pytest.importorskip("yaml")
    assert yaml.safe_load(text)["genes"][1] == {"gene": "b", "status": "failed", "n_products": 0, "product_lengths": [], "reason": "no path found"}
    assert yaml.safe_load(text)["sample"] == "s: 1"
    assert sinks.console_table(results).split("\n")[1].split() == ["a", "ok", "1", "30"]
    sinks.write_text(spark, str(tmp_path / "x.yaml"), text)
    with caplog.at_level("WARNING"):
        sinks.write_text(spark, str(tmp_path / "x.yaml"), "k: 2\n")
    assert "overwriting" in caplog.text and (tmp_path / "x.yaml").read_text() == "k: 2\n"
