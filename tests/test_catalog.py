"""Every query of the catalog against its SQL, over the driver's smallest tables."""

from pathlib import Path
from types import SimpleNamespace

import duckdb
import pytest
from pyspark.sql import functions as F

from gleanwork.plans import catalog

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    found = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    want = sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in found.fetchall()), key=repr)
    df = catalog.QUERIES[name](spark, str(DATA))
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(r) for r in df.select(*sorted(names)).collect()), key=repr) == want


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
def test_greedy_scan(spark):
    rows = spark.read.parquet(str(DATA / "embeddings.parquet")).select("vec_id", "embedding").orderBy("vec_id").collect()
    hashes = {r["vec_id"]: sum(1 << i for i, x in enumerate(r["embedding"][:64]) if x > 0) for r in rows}
    kept = []
    for i, h in hashes.items():
        if not any((h ^ hashes[j]).bit_count() <= 6 for j in kept):
            kept.append(i)
    got = catalog.QUERIES["greedy_near_hashes"](spark, str(DATA)).collect()
    assert sorted(r["vec_id"] for r in got) == kept


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="the driver's tables are not here")
def test_insert_or_ignore_meets_whole_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet").toPandas() for t in ("documents", "labels"))
    first = docs.sort_values("doc_id").drop_duplicates("text")
    known = set(docs[docs["doc_id"].isin(labels["doc_id"])]["text"])
    got = {r["doc_id"] for r in catalog.QUERIES["insert_or_ignore_whole"](spark, "/root/testdata/sf0.01").collect()}
    assert got == set(first[~first["text"].isin(known)]["doc_id"]) and len(got) > 400 and len(known) > 50


@pytest.mark.parametrize("odd, n", [(False, 30), (True, 45)])
def test_history_semi_picks_no_row(spark, tmp_path, odd, n):
    """Rows come in another order each time they are read, as a shuffle between executors brings them; odd: null and repeated ids, null text."""
    docs = [(i, f"t{i % 100}", "en") for i in range(1000)]
    docs += [(None, "t0", "de"), (None, "alone", "de"), (7, "t8", "fr"), (8, None, "fr"), (11, "t10", "fr"), (1001, "", "en"), (1002, "", "de")] * odd
    labels = [(i, 1, 0) for i in [300, 7, 910] + [7, 1002, 5000, None] * odd]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = sorted(con.execute(catalog.ORACLES["history_semi"]).fetchall(), key=repr)
    chance = F.expr("reflect('java.lang.Math', 'random')")
    shuffled = SimpleNamespace(sparkContext=spark.sparkContext, conf=spark.conf, read=SimpleNamespace(parquet=lambda path: spark.read.parquet(path).sortWithinPartitions(chance)))
    got = catalog.QUERIES["history_semi"](shuffled, str(tmp_path)).select("doc_id", "lang").collect()
    assert sorted((tuple(r) for r in got), key=repr) == want and len(want) == n


def test_every_query_is_registered():
    import __spark_entry__

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"greedy_near_hashes"}
