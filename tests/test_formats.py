"""The data sources: any split gives the same rows; missing, empty and broken files; pushed filters."""

import gzip
import io
import random

import pytest

from flankline.sources import files, formats


@pytest.fixture(scope="module", autouse=True)
def known(spark):
    formats.register(spark)


def fasta(rng, n=40):
    out = []
    for k in range(n):
        letters = "".join(rng.choices("ACGT>", k=rng.randrange(1, 90))).lstrip(">") or "A"
        lines = [letters[i : i + 20] for i in range(0, len(letters), 20)]
        out.append((f"p{k}", f"p{k} é description > {k}", letters, "\n".join(x.replace(">", "N") for x in lines)))
    return "".join(f">{d}\n{b}\n" for _, d, _, b in out), [(a, d, b.replace("\n", "")) for a, d, _, b in out]


@pytest.mark.parametrize("split", [1, 7, 64, 10**6])
def test_fasta_splits(spark, tmp_path, split):
    text, want = fasta(random.Random(split))
    (tmp_path / "a.faa").write_text(text)
    with gzip.open(tmp_path / "b.faa.gz", "wt") as f:
        f.write(text.replace("\n", "\r\n"))
    read = spark.read.format("fasta").option("split", str(split if split > 1 else 50))
    assert sorted(map(tuple, read.load(str(tmp_path / "a.faa")).collect())) == sorted(want)
    assert sorted(map(tuple, read.load(str(tmp_path)).collect())) == sorted(want * 2)
    assert sorted(map(tuple, files.read_fasta(spark, str(tmp_path / "a.faa")).collect())) == sorted(want)


@pytest.mark.parametrize("mark", [b"\n", b"\n>"])
def test_each_record_is_read_once(monkeypatch, mark):
    """Whatever the ranges and the pieces that are read."""
    rng = random.Random(1)
    for piece in (1, 3, 50):
        monkeypatch.setattr(formats, "PIECE", piece)
        data = bytes(rng.choices(b"\n>a", k=200))
        whole = list(formats.records(io.BytesIO(data), 0, -1, mark))
        starts = [0] + [i + 1 for i in range(len(data)) if data.startswith(mark, i)]
        assert [at for at, _ in whole] == [s for s in starts if s < len(data)]
        for size in (1, 2, 13, 100):
            parts = [r for s in range(0, len(data), size) for r in formats.records(io.BytesIO(data), s, min(s + size, len(data)), mark)]
            assert parts == whole


def test_a_large_file_is_many_tasks(spark, tmp_path):
    (tmp_path / "a.faa").write_text(fasta(random.Random(2), 400)[0])
    rows = spark.read.format("fasta").option("split", "1000").load(str(tmp_path / "a.faa"))
    assert rows.rdd.getNumPartitions() > 10 and rows.count() == 400


def test_defined_errors(spark, tmp_path):
    def failure(name, text, **options):
        if text is not None:
            (tmp_path / name).write_bytes(text)
        with pytest.raises(Exception) as e:
            spark.read.format(name).options(**options).load(str(tmp_path / name)).collect()
        return str(e.value)

    assert "missing input" in failure("fasta", None)
    assert "empty input" in failure("fasta", b"")
    assert "empty record p2" in failure("fasta", b">p1\nAC\n>p2 x\n>p3\nA\n")
    assert "no header" in failure("fasta", b"AC\n>p\nA\n")
    assert "at byte 8" in failure("fasta", b">p1\nACG\n>p2\n")
    assert "does not start with ##gff-version 3" in failure("gff3", b"a\tb\n")
    assert "8 fields" in failure("gff3", b"##gff-version 3\n" + b"\t".join([b"x"] * 8) + b"\n")
    assert "attribute without value" in failure("gff3", b"##gff-version 3\ns\t.\tCDS\t1\t9\t.\t+\t.\tlone\n")
    assert "13 fields" in failure("diamond", b"\t".join([b"1"] * 13))
    with pytest.raises(FileNotFoundError):
        files.read_fasta(spark, str(tmp_path / "nowhere"))
    (tmp_path / "void").write_text("")
    with pytest.raises(ValueError, match="empty input"):
        files.read_fasta(spark, str(tmp_path / "void"))


def test_permissive_reads(spark, tmp_path):
    (tmp_path / "x").write_text(">p1\nAC\n>p2 x\n>p3\nA\n")
    rows = spark.read.format("fasta").option("mode", "permissive").load(str(tmp_path / "x")).collect()
    assert [(r.accession, r.sequence, r._corrupt) for r in rows] == [("p1", "AC", None), (None, None, ">p2 x"), ("p3", "A", None)]


def test_gff_taxdump_and_hits(spark, tmp_path):
    (tmp_path / "g").write_text("##gff-version 3\n# note\n\ns1\tsrc\tCDS\t5\t9\t.\t-\t0\tID=a%3Bb;Name=x+y;Name=z\ns1\t.\tgene\t1\t9\t2.5\t+\t.\t.\n")
    got = [tuple(r) for r in spark.read.format("gff3").option("split", "20").load(str(tmp_path / "g")).collect()]
    assert got == [("s1", "src", "CDS", 5, 9, None, "-", 0, {"ID": "a;b", "Name": "z"}), ("s1", ".", "gene", 1, 9, 2.5, "+", None, {})]
    assert sorted(map(str, got)) == sorted(str(tuple(r)) for r in files.read_gff3(spark, str(tmp_path / "g")).collect())
    (tmp_path / "nodes").write_text("1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tgenus\t|\n")
    (tmp_path / "names").write_text("1\t|\troot\t|\t\t|\tscientific name\t|\n1\t|\tall\t|\t\t|\tsynonym\t|\n2\t|\tBacillus\t|\t\t|\tscientific name\t|\n")
    nodes, names = (spark.read.format(f"taxdump_{n}").load(str(tmp_path / n)) for n in ("nodes", "names"))
    assert sorted(map(tuple, nodes.join(names, "taxon_id").collect())) == [(1, 1, "no rank", "root"), (2, 1, "genus", "Bacillus")]
    (tmp_path / "hits").write_text("q\ts\t99.5\t10\t0\t0\t1\t10\t1\t10\t1e-9\t50\t98\t97\n")
    assert spark.read.format("diamond").load(str(tmp_path / "hits")).first()[2:] == (99.5, 10, 0, 0, 1, 10, 1, 10, 1e-9, 50.0, 98.0, 97.0)


def test_filters_are_pushed(spark, tmp_path):
    text, want = fasta(random.Random(3))
    (tmp_path / "a.faa").write_text(text)
    rows = spark.read.format("fasta").load(str(tmp_path / "a.faa")).where("accession = 'p7' AND length(sequence) > 0")
    assert [tuple(r) for r in rows.collect()] == [w for w in want if w[0] == "p7"]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "length(" in plan and "= p7" not in plan  # the source has taken the equality over
