"""Catalogue, decoder configuration, alignment files and command line."""

import gzip

import pytest
from pyspark.sql import functions as F

from phrasepivot.cli import main, parser
from phrasepivot.plans.catalog import bilingual, corpus_groups, languages, monolingual, pivot_corpora, report_lines, scan_corpora, undersized
from phrasepivot.plans.decoder_config import DecoderConfig, find_tables
from phrasepivot.sources import listing
from phrasepivot.sources.alignments import alignment_name_columns, parse_alignment_name, prepare_training, read_alignment


@pytest.fixture
def corpora(tmp_path):
    for f in ("cs/m.cs", "uk/n.uk", "csen/a.cs", "csen/a.en", "csen/b.cs", "csen/b.en", "enuk/w.en", "enuk/w.uk", "csdeuk/k.cs", "csdeuk/k.de", "csdeuk/k.uk", "csd/x.cs", "csen/1.cs"):
        (tmp_path / f).parent.mkdir(exist_ok=True)
        (tmp_path / f).write_text("x\n")
    return tmp_path


def short(path):
    return "/".join(path.split("/")[-2:])


def test_catalogue(spark, corpora):
    groups = corpus_groups(scan_corpora(spark, str(corpora))).persist()
    assert dict(groups.groupBy("dir").count().collect()) == {"cs": 1, "uk": 1, "csen": 2, "enuk": 1, "csdeuk": 1}
    assert {(k, short(f)) for k, f in monolingual(groups, "uk").collect()} == {("mono", "uk/n.uk"), ("multi", "enuk/w.uk"), ("multi", "csdeuk/k.uk")}
    assert [(r.dir, short(r.file_a), short(r.file_b)) for r in bilingual(groups, "cs", "uk").collect()] == [("csdeuk", "csdeuk/k.cs", "csdeuk/k.uk")]
    got = {(r.pvt, r.side, short(r.file_pvt), short(r.file_other)) for r in pivot_corpora(groups, "cs", "uk").collect()}
    assert got == {("en", "src", "csen/a.en", "csen/a.cs"), ("en", "src", "csen/b.en", "csen/b.cs"), ("en", "tgt", "enuk/w.en", "enuk/w.uk")}
    report = [r.value for r in report_lines(groups, "cs", "uk").collect()]
    assert report[:2] == ["+- Corpora for LM", "|  | LANG=uk"]
    assert "|  |  +- Pivot: en" in report


@pytest.mark.parametrize("by_tasks", [True, False])
def test_listing(spark, tmp_path, monkeypatch, by_tasks):
    """Files of the second level only, empty ones too, but no check sums of Spark's; a task for each directory."""
    if not by_tasks:  # a file system that pyarrow doesn't open
        monkeypatch.setattr(listing, "pyarrow_uri", lambda spark, path: None)
    root = tmp_path / "a é%20b"
    (root / "none").mkdir(parents=True)
    (root / "top.cs").write_text("")
    wanted = spark.createDataFrame([(f"d{i}/é {i}.cs",) for i in range(6)] + [("d0/deeper/x.cs",), ("d0/.m",)], "file string")
    assert listing.create_empty(wanted, f"{root}/") == 8
    (root / "d1" / ".é 1.cs.crc").write_text("x")
    found = scan_corpora(spark, f"{root}/")
    assert sorted(map(tuple, found.collect())) == sorted([(f"d{i}", f"{root}/d{i}/é {i}.cs") for i in range(6)] + [("d0", f"{root}/d0/.m")])
    assert not by_tasks or found.rdd.getNumPartitions() == 7
    (tmp_path / "empty").mkdir()
    assert scan_corpora(spark, str(tmp_path / "empty")).count() == 0


def test_listing_checks(spark, corpora):
    files = scan_corpora(spark, str(corpora))
    assert {r.lang for r in languages(files).collect()} == {"cs", "uk", "en", "de"}
    assert undersized(files).count() == 0
    assert [tuple(r) for r in undersized(files.where("file not like '%.de'")).collect()] == [("csdeuk", 2, 3)]


def test_decoder_config(spark, tmp_path):
    text = DecoderConfig(find_tables(spark, "/x/phrase-table.a:/y/phrase-table.b")).text()
    names = [x for x in text.split("\n") if x.startswith("[")]
    assert names == ["[input-factors]", "[mapping]", "[decoding-graph-backoff]", "[distortion-limit]", "[feature]", "[weight]"]
    assert "[mapping]\n0 T 0\n1 T 1\n" in text and "TranslationModel1= 0.2 0.2 0.2 0.2" in text
    assert "PhraseDictionaryMemory name=TranslationModel1 num-features=4 path=/y/phrase-table.b input-factor=0 output-factor=0 table-limit=20" in text
    (tmp_path / "model").mkdir()
    (tmp_path / "model/phrase-table.gz").write_text("")
    (tmp_path / "model/lex.e2f").write_text("")
    assert find_tables(spark, str(tmp_path)) == [f"{tmp_path}/model/phrase-table.gz"]


def test_alignment_names(spark):
    name = parse_alignment_name("d/Opus.encs.ali.gz")
    assert (name.corpus, name.source, name.target) == ("Opus", "en", "cs")
    assert name.corpora("d") == ("d/Opus.en.tok.gz", "d/Opus.cs.tok.gz")
    assert parse_alignment_name("C.encs.x.ali").pipe == "encs"
    for bad in ("encs.ali", "a.b.c", "a.ali.b.c"):
        with pytest.raises(ValueError):
            parse_alignment_name(bad)
    df = spark.createDataFrame([("d/Opus.encs.ali.gz",), ("a.b.c",), (None,)], "p string")
    assert [tuple(r) for r in df.select(*(c.alias(k) for k, c in alignment_name_columns(F.col("p")).items())).collect()] == [("Opus", "encs", "en", "cs"), (None,) * 4, (None,) * 4]


def test_prepare_training(spark, tmp_path):
    for name, text in (("C.encs.ali.gz", "0-0 1-1\t5\tx\n\t\n"), ("C.en.tok.gz", "a b\n"), ("C.cs.tok.gz", "c d\n")):
        with gzip.open(tmp_path / name, "wt") as f:
            f.write(text)
    prepare_training(spark, str(tmp_path / "C.encs.ali.gz"), str(tmp_path / "out"))
    assert [r.value for r in read_alignment(spark, str(tmp_path / "C.encs.ali.gz")).collect()] == ["0-0 1-1", ""]
    assert [r.value for r in spark.read.text(str(tmp_path / "out/encs/corpus.src.gz")).collect()] == ["a b"]
    with gzip.open(tmp_path / "out/encs/alignment.custom.gz", "rt") as f:
        assert f.read() == "0-0 1-1\n\n"
    args = (tmp_path / "out/encs/train.args").read_text().split("\n")
    assert f"--corpus={tmp_path}/out/encs/corpus" in args and args[5:7] == ["--root-dir", f"{tmp_path}/out/model.encs.C"]


def test_command_line(spark, corpora, tmp_path):
    line = "p ||| {} ||| 0.5 0.5 0.5 0.5 ||| 0-0 ||| 1 1 1\n"
    for n in "st":
        (tmp_path / n).write_text(line.format(n))
    assert main(["triangulate", "features_based", "-s", str(tmp_path / "s"), "-t", str(tmp_path / "t"), "-m", "pspt", "-o", str(tmp_path / "o"), "-co", "max", "--write-phrase-penalty", "--number_of_features", "5"]) == 0
    assert (tmp_path / "o").read_text() == "s ||| t ||| 0.25 0.25 0.25 0.25 0 ||| 0-0 ||| 1 1 1 ||| |||\n"
    assert main(["catalog", "-s", "cs", "-t", "uk", "-c", str(corpora), "-o", str(tmp_path / "report")]) == 0
    assert (tmp_path / "report").read_text().startswith("+- Corpora for LM\n")
    assert main(["decoder-config", "-TMS", "/x/phrase-table", "-o", str(tmp_path / "ini")]) == 0
    with pytest.raises(SystemExit):
        parser().parse_args(["triangulate", "features_based"])
