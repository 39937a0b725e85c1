"""The pipeline's stages on a small folder of tables, each against a plain version of its decision."""

from __future__ import annotations

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tessera.llm import simhash_dups, toxicity_net  # noqa: E402
from tests.llm.test_ops_dups import line_oracle, union_find  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    path = str(tmp_path_factory.mktemp("tables"))
    words = [f"{a}{b}n{c}" for a in "bcdfg" for b in "aeiou" for c in range(9)]
    benchmark = [(i, " ".join(f"q{i}w{j}" for j in range(25))) for i in range(4)]
    rows, labels = [], []
    for i in range(240):
        lines = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(4)]
        toxic = i % 4 == 0
        if toxic:
            lines[1] += f" zork{'xyzuvw'[i % 6]} zork{'uvwxyz'[i % 6]}"
        if i in (1, 2, 3):
            lines.insert(2, benchmark[i][1])
        if i % 9 == 5:
            lines.insert(0, "A boilerplate line that all of these documents share")
        rows.append((i, "\n".join(lines), "en", f"src{0 if i % 3 == 0 else i % 5}", 0))
        labels.append((i, 1, int(toxic)))
    rows += [(300, rows[5][1] + "\nmore of the same here", "en", None, 0), (301, None, "en", "src1", 0), (302, "", "fr", "src2", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_each_stage_decides_on_all_its_input(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, frames = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        frames.append({r.doc_id: r for r in docs.collect()})
        if i < 4:
            assert docs.columns == columns
    source = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    clean, lined, single, pure, mixed = frames
    wrong = [i for i in range(240) if (i in clean) != (i % 4 != 0)]
    assert len(wrong) <= 5 and {301, 302} <= set(clean)
    want = line_oracle([(i, source[i].text) for i in clean])
    assert {i: r.text for i, r in lined.items()} == want and all(r.n_chars == len(r.text) for r in lined.values() if r.text is not None)
    ids = sorted(lined)
    prints = [simhash_dups.fingerprint(lined[i].text, 5) for i in ids]
    root = union_find(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if bin(prints[a] ^ prints[b]).count("1") <= 3])
    assert sorted(single) == sorted(ids[i] for i in set(root))
    dirty = {1, 2, 3} & set(single)
    assert set(pure) == set(single) - dirty and dirty
    assert set(mixed) == set(pure) and sum(r.taken for r in mixed.values()) > 0
    assert all(r.taken == r.size * r.copies <= 3 * r.size for r in mixed.values())


def test_run_and_registration(spark, folder):
    import __spark_entry__ as entry

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "mixing"]
    assert entry.queries()["pipeline"] is corpus_pipeline.run and "pipeline" not in entry.oracle_sql()
    assert corpus_pipeline.run(spark, folder).count() > 100


def test_network_score_column_survives_null_text(spark):
    net = toxicity_net.fit_texts(["a zork b", "c d e"] * 10, [1, 0] * 10)
    out = toxicity_net.with_scores(spark.createDataFrame([(None,), ("",), ("x",)], "text string"), net, "s").collect()
    assert len(out) == 3 and all(0 <= r.s <= 1 for r in out)


def test_rows_of_null_and_repeated_ids_are_decided_each(spark, folder):
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(40)) for _ in range(6)]
    passage = spark.read.parquet(f"{folder}/benchmark.parquet").where("item_id = 1").first().text
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (8, texts[4]), (None, texts[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted([(str(i), t) for i, t in [rows[0], rows[1], rows[3], rows[4], rows[5]]])
    for kept in (simhash_dups.keep_one(docs), corpus_pipeline.drop_near_duplicates(spark, docs, folder)):
        assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == want
    dirty = spark.createDataFrame([(None, passage), (None, texts[0]), (7, texts[2]), (7, f"{texts[3]} {passage}")], "doc_id long, text string")
    pure = corpus_pipeline.drop_contaminated(spark, dirty, folder).collect()
    assert sorted((str(r.doc_id), r.text) for r in pure) == sorted([("None", texts[0]), ("7", texts[2])])
