import gzip

import pytest

from strandlake.cli import contigs_of_files, run
from strandlake.operators.archive import Collection

from .test_archive import TOY


def out(spark, *argv):
    return "".join(run(spark, list(map(str, argv))))


def test_commands_on_the_toy_files(spark, tmp_path):
    for s, contigs in TOY.items():
        (tmp_path / f"{s}.fa").write_text("".join(f">{n}\n{q}\n" for n, q in contigs))
    c = f"file://{tmp_path}/col"
    out(spark, "create", "-o", c, tmp_path / "ref.fa", tmp_path / "a.fa", tmp_path / "a.fa")
    (tmp_path / "list").write_text(f"{tmp_path}/b.fa\n{tmp_path}/c.fa")
    out(spark, "append", "-o", c, "-i", tmp_path / "list")
    assert out(spark, "listref", c) == "ref"
    assert out(spark, "listset", c) == "a\nb\nc\nref\n"
    assert out(spark, "listctg", c, "a", "zzz") == "a\n   chr1a\n   chr3a\nzzz\n"
    assert out(spark, "getctg", c, "chr3a@a:0-3", "seq") == ">chr3a:0-3\nAGTT\n>seq\nTGTGTGTGTG\n"
    assert out(spark, "getset", "-l", 5, c, "a") == ">chr1a\nCTGAGCTGACTGA\n>chr3a\nAGTTTAGCT\n"  # lines of 40 letters at least
    assert out(spark, "getset", "-s", c, "c", "a") == out(spark, "getset", c, "c", "a")
    assert out(spark, "getctg", "-s", c, "chr3a@a:2-5", "seq") == ">chr3a:2-5\nTTTA\n>seq\nTGTGTGTGTG\n"
    out(spark, "getctg", "-g", 3, "-o", f"file://{tmp_path}/ctg.fa.gz", c, "seq")
    assert gzip.decompress((tmp_path / "ctg.fa.gz").read_bytes()) == b">seq\nTGTGTGTGTG\n"
    out(spark, "getset", "-o", f"file://{tmp_path}/set.fa", c, "a")
    assert (tmp_path / "set.fa").read_text() == out(spark, "getset", c, "a")
    out(spark, "listset", "-o", f"file://{tmp_path}/names", c)
    assert (tmp_path / "names").read_text() == "a\nb\nc\nref\n"
    whole = "".join(f">{n}\n{q}\n" for contigs in TOY.values() for n, q in contigs)
    assert out(spark, "getcol", c) == whole
    assert out(spark, "getcol", "-r", c) == whole[whole.index(">chr1a") :]
    assert "n_samples: 4\n" in out(spark, "info", c) and "strandlake append" in out(spark, "info", c)
    with pytest.raises(SystemExit, match="several"):
        out(spark, "getctg", c, "chr1")
    out(spark, "getcol", "-f", "-o", f"file://{tmp_path}/all", c)
    assert {p.name: p.read_text() for p in (tmp_path / "all").glob("*.fa")} == {f"{s}.fa": "".join(f">{n}\n{q}\n" for n, q in x) for s, x in TOY.items()}
    assert "producer: strandlake" in out(spark, "info", "-v", 1, c) and "producer" not in out(spark, "info", c)
    with pytest.raises(SystemExit, match="no such"):
        out(spark, "getctg", "-s", c, "nope")


def test_concatenated_genomes(spark, tmp_path):
    (tmp_path / "many.fa").write_text(">g1 x\nACGT\n>g2 y\nTTTT\n")
    c = f"file://{tmp_path}/col"
    out(spark, "create", "-c", "-o", c, tmp_path / "many.fa")
    assert out(spark, "listset", c) == "g1\ng2\n" and out(spark, "getctg", c, "g2@g2:1-2") == ">g2 y:1-2\nTT\n"
    (tmp_path / "more.fa").write_text(">g3\nAC\n>g4\nGG\n")
    d = f"file://{tmp_path}/col2"
    out(spark, "create", "-c", "-d", "-o", d, tmp_path / "many.fa", tmp_path / "more.fa")
    assert Collection(spark, d).list_samples(False) == ["g1", "g2", "g3", "g4"]
    assert out(spark, "getcol", d) == ">g1 x\nACGT\n>g2 y\nTTTT\n>g3\nAC\n>g4\nGG\n"
    with pytest.raises(ValueError, match="already"):
        out(spark, "append", "-c", "-o", d, tmp_path / "more.fa")


def test_files_of_one_name_and_files_without_contigs(spark, tmp_path):
    for folder, text in (("a", ">c1\nACGT\n"), ("b b", ">c2\nTTTT\n"), ("c", "\n")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / ("s.fa" if folder != "c" else "t.fa")).write_text(text)
    found = {(r["sample_ord"], r["sample"], r["contig"]) for r in contigs_of_files(spark, [str(tmp_path / "a/s.fa"), str(tmp_path / "b b/s.fa")]).collect()}
    assert found == {(0, "s", "c1"), (1, "s", "c2")}
    with pytest.raises(ValueError, match="twice"):
        out(spark, "create", "-o", f"file://{tmp_path}/col", tmp_path / "a/s.fa", tmp_path / "b b/s.fa")
    with pytest.warns(UserWarning, match="no contigs"):
        out(spark, "create", "-o", f"file://{tmp_path}/col", tmp_path / "a/s.fa", tmp_path / "c/t.fa")
    assert Collection(spark, f"file://{tmp_path}/col").list_samples() == ["s"]
