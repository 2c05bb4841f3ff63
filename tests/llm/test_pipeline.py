import random

import pytest

import __spark_entry__ as entry_module

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_every_operator_is_registered():
    names = entry_module.queries()
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in names)] == [] and "pipeline" in names
    assert set(entry_module.oracle_sql()) <= set(names)


def test_planted_cases_go_and_clean_documents_stay(spark, tmp_path):
    r = random.Random(8)
    syllables = [a + b for a in "bcdfghklm" for b in ("a", "en", "or", "ist", "u")]

    def prose(n):
        return [r.choice(syllables) + r.choice(syllables) for _ in range(n)]

    docs, toxic, gone = [], [], set()
    for i in range(400):
        words = prose(r.randint(60, 150))
        if i % 5 == 0:
            for _ in range(4):
                words.insert(r.randrange(len(words)), r.choice(["zorblat", "snurgling", "idiot"]))
            gone.add(i)
        toxic.append((i, int(i % 5 == 0)))
        docs.append((i, " ".join(words)))
    item = " ".join(prose(30))
    base = " ".join(prose(200))
    docs += [(1000, base), (1001, base), (1002, base + " tail"), (1003, base.upper()), (1004, item + " " + " ".join(prose(100))), (1005, item + " " + " ".join(prose(900))), (1006, ""), (1007, None), (None, " ".join(prose(20)))]
    gone |= {1001, 1002, 1003, 1004}
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(d, 1, t) for d, t in toxic], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(repr, (x["doc_id"] for x in got))) == sorted(map(repr, (d for d, _ in docs if d not in gone)))
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, table, str(tmp_path)).dtypes == table.dtypes
