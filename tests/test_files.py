"""Readers, writers, incremental ingest and the result store."""

import json
import lzma

import pytest
from pyspark.sql import functions as F

from tidemark.operators import embed as E, windows as W
from tidemark.operators.clean import Preprocessor
from tidemark.sources import documents as D, store as ST, tables as TB
from tidemark.streaming.ingest import ingest_dir

HEAD = "/Volumes/External/txt/0000000-0100000/US{}.txt"


def bundle(*docs):
    return "".join(f"{HEAD.format(i)}{text}\n" for i, text in docs)


@pytest.fixture
def raw(tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    text = bundle((1009, " First\nsecéond   line\r\nthird"), (1010, ""), (1011, " a\n/Volumes/stray line\nb"))
    (folder / "one.txt").write_bytes(text.encode("latin-1"))
    return folder


def test_bundle(spark, raw):
    got = {r["patent"]: r for r in D.read_raw_bundle(spark, str(raw)).collect()}
    assert got[1009]["contents"] == "Firstsecéond linethird" and got[1009]["file"] == HEAD.format(1009)
    assert got[1010]["contents"] == "" and got[1011]["contents"] == "a/Volumes/stray lineb"


def test_bundle_in_many_splits(spark, tmp_path):
    text = bundle(*[(i, f" text {i}\n/Volumes/{'no header ' * (i % 3)}\nend") for i in range(1, 400)])
    (tmp_path / "big.txt").write_bytes(text.encode("latin-1"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = {r["patent"]: r["contents"] for r in D.read_raw_bundle(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {i: f"text {i}/Volumes/{'no header ' * (i % 3)}end" for i in range(1, 400)}


def test_year_lookup(spark, raw):
    years = spark.createDataFrame([(1009, 1960)], "pat long, year int")
    got = {r["patent"]: r["year"] for r in D.read_raw_bundle(spark, str(raw), years).collect()}
    assert got == {1009: 1960, 1010: None, 1011: None}


def test_ingest_only_new_files_and_documents(spark, raw, tmp_path):
    years = spark.createDataFrame([(i, 1960 + i % 3) for i in range(1000, 1020)], "pat long, year int")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "check")
    ingest_dir(spark, str(raw), years, out, checkpoint)
    assert D.read_by_year(spark, out).count() == 3
    (raw / "two.txt").write_bytes(bundle((1010, " later"), (1012, " new")).encode("latin-1"))
    ingest_dir(spark, str(raw), years, out, checkpoint)
    ingest_dir(spark, str(raw), years, out, checkpoint)
    got = {r["patent"]: r["contents"] for r in D.read_by_year(spark, out).collect()}
    assert got[1010] == "" and got[1012] == "new" and len(got) == 4


def documents():
    good = [{"patent": i, "file": "f", "contents": f'text "{i}" [é]', "year": 1870} for i in range(8)]
    return good + [
        {"patent": 8, "file": "f", "contents": "no year", "year": 0},
        {"patent": 9, "file": "f", "contents": "", "year": 1870},
    ]


def test_document_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps(d) for d in documents()), encoding="utf-8")
    with lzma.open(tmp_path / "1870.xz", "wt", encoding="utf-8") as handle:
        json.dump(documents(), handle, indent=1, ensure_ascii=False)
    for path, n in (("a.jsonl", 10), ("1870.xz", 10), ("", 20)):
        docs = D.read_documents(spark, str(tmp_path / path) if path else str(tmp_path))
        assert docs.count() == n
        assert Preprocessor().accepted(docs).count() == n * 8 // 10
    assert D.read_year_xz(spark, str(tmp_path)).where("patent = 3").first()["contents"] == 'text "3" [é]'
    with pytest.raises(ValueError):
        D.read_documents(spark, str(tmp_path / "a.pdf"))


def test_json_items_across_reads():
    import io

    text = json.dumps([{"a": "x" * n, "b": [1, {"c": "]"}]} for n in range(30)])
    items = list(D.json_items(io.StringIO(text), size=7))
    assert [json.loads(i) for i in items] == json.loads(text)
    assert list(D.json_items(io.StringIO("[]"))) == []
    with pytest.raises(ValueError):
        list(D.json_items(io.StringIO('[{"a": 1}, {"b": ')))


def test_word_lists(spark, tmp_path):
    (tmp_path / "lex.txt").write_text("one\n two \none\n", encoding="utf-8")
    assert {r["word"] for r in TB.read_lexicon(spark, str(tmp_path / "lex.txt")).collect()} == {"one", "two"}
    with pytest.raises(AssertionError):
        TB.read_lexicon(spark, str(tmp_path / "lex.pdf"))
    (tmp_path / "greek.txt").write_text("l,1,2,3\n?,α,&a;,.alpha.,alpha\n?,-,&b;,-,beta\n", encoding="utf-8")
    got = {(r["variant"], r["standard"]) for r in TB.read_greek(spark, str(tmp_path / "greek.txt")).collect()}
    assert got == {("α", "alpha"), ("&a;", "alpha"), (".alpha.", "alpha"), ("&b;", "beta")}


def vectors(spark, model, window, value):
    return spark.createDataFrame(
        [(model, window, i, 1900, [value]) for i in range(3)],
        "model string, window string, patent long, year int, embedding array<double>",
    )


def test_store(spark, tmp_path):
    store = ST.ResultStore(spark, str(tmp_path / "res"))
    store.put("embeddings", vectors(spark, "p-a", "1-2", 1.0))
    store.put("embeddings", vectors(spark, "p-a", "1-2", 2.0))
    assert store.get("embeddings", model="p-a").first()["embedding"] == [1.0]
    store.put("embeddings", vectors(spark, "p-a", "1-2", 3.0), overwrite=True)
    store.put("embeddings", vectors(spark, "p-b", "1-2", 4.0))
    assert store.get("embeddings", model="p-a", window="1-2").first()["embedding"] == [3.0]
    with pytest.raises(KeyError):
        store.get("embeddings", model="none")

    docs = spark.createDataFrame([("1-2", 1, 1), ("1-2", 2, 2)], "window string, patent long, year int")
    store.put_window(docs)
    store.put_window(docs)
    assert store.read("windows").count() == 2 and store.has_window("1-2") and not store.has_cpc("1-2")
    with pytest.raises(AssertionError):
        store.put_window(docs.where("patent = 1"))
    with pytest.raises(ValueError):
        store.put_window(docs.withColumn("year", F.lit(None).cast("int")))
    assert store.has_run("p", "a", "1-2") and not store.has_run("p", "a", "1-3")

    other = ST.ResultStore(spark, str(tmp_path / "other"))
    other.put("embeddings", vectors(spark, "p-a", "1-2", 9.0).unionByName(vectors(spark, "p-c", "1-2", 9.0)))
    store.merge(other.path, delete_copy=True)
    assert store.get("embeddings", model="p-a").first()["embedding"] == [3.0]
    assert {r["model"] for r in store.model_names().collect()} == {"p-a", "p-b", "p-c"}
    with pytest.raises(FileNotFoundError):
        store.merge(other.path)
    store.remove_model("p-c")
    with pytest.raises(KeyError):
        store.remove_model("p-c")


def test_settings(spark, tmp_path):
    store = ST.ResultStore(spark, str(tmp_path / "res"))
    tfidf = E.Tfidf(ngram_max=2, stop_words=("a", "the"), norm=None, max_df=0.5)
    store.put_settings("model", {"tfidf": tfidf, "count": E.WeightedCounts("prop")})
    store.put_settings("model", {"tfidf": E.Tfidf()})
    store.put_settings("preprocessor", {"prep": Preprocessor(keep_caps=True)})
    assert store.load_model("tfidf") == tfidf and store.load_model("count") == E.WeightedCounts("prop")
    assert store.load_preprocessor("prep") == Preprocessor(keep_caps=True)
    assert store.has_setting("model", "tfidf") and not store.has_setting("preprocessor", "tfidf")
    with pytest.raises(KeyError):
        store.load_model("none")
    with pytest.raises(ValueError, match="no embedder"):
        E.create_model("NoSuchModel", {})


def test_run_spec(spark, tmp_path):
    store = ST.ResultStore(spark, str(tmp_path / "res"))
    assert store.check_spec(W.WindowSpec(1900, 1920, 5))
    assert store.check_spec(W.WindowSpec(1910, 1930, 5, 1))
    assert not store.check_spec(W.WindowSpec(1900, 1920, 6))
