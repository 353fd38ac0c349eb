"""The grams of files: in order from the start, so that no task sorts postings, and no files moved to meet them."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lodestar import queries as own
from lodestar.operators import index, search
from lodestar.plans.query import parse
from lodestar.schema import CORPUS


def told(texts):
    texts = [f"{t}\n" for t in texts]
    return [(g, int(i)) for codes, places in index._distinct(texts) for g, i in zip(codes.tolist(), places.tolist(), strict=True)]


def expected(texts):
    return sorted((index.gram_code(t[i : i + 3]), n) for n, t in enumerate(texts) for i in {t[i : i + 3]: i for i in range(len(t) - 2) if "\n" not in t[i : i + 3]}.values())


@pytest.mark.parametrize("texts", [[], [""], ["ab"], ["\n\n\n\n"], ["aaaa"], ["abc\ndef\n", "", "cab\n", "abcabc"], ["a😀b😀a😀b", "\x00\x00\x00"]])
def test_pairs_come_once_in_order(texts):
    assert told(texts) == expected(texts)


def test_texts_of_very_many_characters():
    """Their pairs do not fit one number each, so they come in parts."""
    pick = random.Random(1)
    texts = ["".join(chr(pick.randrange(0x20, 0xD800) if pick.random() < 0.5 else pick.randrange(0x10000, 0x110000)) for _ in range(3000)) for _ in range(60)] + ["abcd"] * 6000
    parts = list(index._distinct([f"{t}\n" for t in texts]))
    assert len(parts) > 1
    assert all((codes[1:] >= codes[:-1]).all() for codes, _ in parts)
    assert sorted(told(texts)) == expected(texts)


def test_postings_are_in_the_order_of_grams(spark):
    """A store writes them as they come: sorting them took memory that grew with the files a task reads."""
    rows = [(f"f{i:02}", "", False, None, f"some{i} words {chr(122 - i)}{i}") for i in range(20)]
    grams = [r.gram for r in index.postings(spark.createDataFrame(rows, CORPUS).coalesce(1)).collect()]
    assert len(grams) > 200 and grams == sorted(grams)


def test_stored_files_are_in_the_order_of_their_numbers(spark, tmp_path):
    """A scan for some of them skips pages by it."""
    files = spark.createDataFrame([(f"f{i}", f"r{i % 2}", False, None, "alpha") for i in range(400)], CORPUS)
    name = index.Store(spark, f"file://{tmp_path}/s").write(files, "committed")
    parts = [pq.ParquetFile(f).read(["file"])["file"].to_pylist() for f in tmp_path.glob(f"s/{name}/*/*.parquet")]
    assert sum(map(len, parts)) == 400 and all(p == sorted(p) for p in parts)


@pytest.mark.parametrize(("sent", "join"), [(500_000, "BroadcastHashJoin"), (0, "SortMergeJoin")])
def test_many_candidates(spark, monkeypatch, tmp_path, sent, join):
    """More files than are named to the scan are looked at where they lie, while their numbers can be sent."""
    monkeypatch.setattr(index, "LISTED", 3)
    monkeypatch.setattr(index, "SENT", sent)
    files = spark.createDataFrame([(f"f{i}", "", False, None, "alpha beta" if i % 2 else "gamma") for i in range(40)], CORPUS)
    store = index.Store(spark, f"file://{tmp_path}/s")
    store.publish(index.Manifest(committed=store.write(files, "committed")))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = store.index().narrowed(store.numbered(), parse("alpha"))
        assert join in rows._jdf.queryExecution().executedPlan().toString()
        assert {r.path for r in rows.collect()} == {f"f{i}" for i in range(40) if i % 2}
        assert search.matched(store.numbered(), parse("alpha"), store.index()).count() == 20
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


@pytest.mark.parametrize("listed", [1000, 1])
def test_gram_files_of_odd_tables(spark, monkeypatch, tmp_path, listed):
    """Documents that repeat a number are one file, and those without one have no path."""
    monkeypatch.setattr(index, "LISTED", listed)
    monkeypatch.setattr(index, "_COUNTED", 16)
    ids = [1, 2, 2, 2, 3, 13, 13, None, None, 5, 6]
    texts = ["The cat", "the hat", "the hat", "the bat\nsat", "other theme", "the the", "then", "nameless", "nameless too", None, ""]
    docs = pa.table({"doc_id": pa.array(ids, pa.int64()), "text": texts, "lang": ["en"] * 10 + [None], "source": ["src"] * 11, "n_chars": pa.array([0] * 11, pa.int64())})
    pq.write_table(docs, tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([1, 1, 2], pa.int64()), "text": ["the item", "an item", "x"]}), tmp_path / "benchmark.parquet")
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got = own.QUERIES["trigram_postings"](spark, str(tmp_path))
    want = db.sql(own.ORACLE["trigram_postings"])
    assert {tuple(r) for r in got.select(*want.columns).collect()} == set(want.fetchall())
    assert got.count() == got.distinct().count() > 30


def test_files_do_not_move_to_meet_their_grams(spark):
    files = spark.createDataFrame([(f"f{i}", "r", False, None, "alpha beta") for i in range(40)], CORPUS)
    plan = index.gram_files(files)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
