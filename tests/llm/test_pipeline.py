"""The pipeline as a whole, and the queries that SQL can check."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from oracle import compare, engine
from pricetide.llm import langid
from pricetide.llm.queries import ORACLES, QUERIES
from pricetide.session import drop_staged, shared_dir

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return engine(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, ORACLES[name]) == ""


def test_all_operators_and_the_pipeline_are_registered():
    import __spark_entry__ as entry
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)} and "pipeline" in entry.queries()


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, before = docs.columns, {r.doc_id for r in docs.collect()}
    for name, function in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(function(spark, docs, SF))
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= before and now, name
        assert name == "pack_batches" or docs.columns == names
        before = now
    assert {"bucket", "batch", "place"} <= set(docs.columns)


def test_planted_cases(spark, make_docs):
    base = " ".join(f"the{i} and{i % 7} with{i % 5}" for i in range(60))
    clean = [(i, f"the dog number {i} and some thing that was clean{i} in every way {i * 7}") for i in range(100, 140)]
    rows = [(1, base), (2, base), (3, base.replace("the30", "other")), (4, "12345 !!! 678"), (5, None), (6, base + "\nand one more line with own words")] + clean
    docs = make_docs(rows)
    first = corpus_pipeline.identify_language(spark, docs, SF)
    assert {r.doc_id for r in first.collect()} == {r[0] for r in rows} - {4, 5}
    second = corpus_pipeline.dedup_lines(spark, first, SF)
    kept = {r.doc_id: r.text for r in second.collect()}
    assert 2 not in kept and 3 not in kept and kept[6] == "and one more line with own words" and {i for i, _ in clean} <= set(kept)
    third = corpus_pipeline.drop_near_duplicates(spark, first, SF)
    assert {1, 6} - {r.doc_id for r in third.collect()} <= {6} and 2 not in {r.doc_id for r in third.collect()}


def test_empty_table_passes_through(spark, make_docs):
    docs = make_docs([])
    for _, function in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(function(spark, docs, SF))
    assert docs.count() == 0


def test_repeated_rows_leave_one(spark, make_docs):
    docs = make_docs([(1, "the dog and the cat are here")] * 4)
    for _, function in corpus_pipeline.STAGES[:3]:
        docs = corpus_pipeline.stage(function(spark, docs, SF))
    assert docs.count() == 1


def test_staged_tables_can_be_removed(spark):
    corpus_pipeline.stage(spark.range(3))
    assert drop_staged(spark) > 0 and shared_dir(spark)


def test_no_model_without_labels(spark, make_docs):
    unlabelled = make_docs([(1, "words"), (2, "12")]).drop("lang").selectExpr("*", "cast(null as string) as lang")
    assert langid.fit(unlabelled) is None
    assert [r.doc_id for r in corpus_pipeline.identify_language(spark, unlabelled, SF).collect()] == [1]


FOREIGN = [
    "今天天气很好，我们一起去公园散步吧。孩子们在草地上奔跑玩耍，老人们坐在长椅上聊天。", "今日はとても良い天気なので、みんなで公園に行きましょう。",
    "Сегодня хорошая погода, и мы пойдём гулять в парк. Дети играют на траве.", "Σήμερα ο καιρός είναι πολύ καλός και θα πάμε μια βόλτα στο πάρκο.",
    "الطقس جميل اليوم وسنذهب للتنزه في الحديقة. الأطفال يلعبون على العشب.", "오늘은 날씨가 아주 좋아서 우리는 공원에 산책하러 갑니다.",
    "Tänään on hyvin kaunis sää ja menemme yhdessä puistoon kävelylle. Lapset leikkivät nurmikolla ja vanhukset istuvat penkeillä.",
    "Dzisiaj jest bardzo ładna pogoda i idziemy razem na spacer do parku. Dzieci bawią się na trawie."]


@pytest.mark.parametrize("label", [None, "en"])
def test_foreign_and_random_texts_go_and_clean_ones_stay(spark, label):
    draw = random.Random(5)
    noise = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(n)) for n in (60, 400, 3000)]
    planted = [(10**9 + i, text, label, "s", len(text)) for i, text in enumerate(FOREIGN + noise)]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(*corpus_pipeline.COLUMNS)
    clean = {r.doc_id for r in docs.where(F.col("text").rlike(r"\p{L}")).collect()}
    first = corpus_pipeline.identify_language(spark, docs.unionByName(spark.createDataFrame(planted, docs.schema)), SF)
    assert {r.doc_id for r in first.select("doc_id").collect()} == clean


def test_language_with_few_labels_stays(spark, make_docs):
    few = [(i, text, "zh" if i < 2 else None, "s", 9) for i, text in enumerate(["今天天气很好，我们去公园。", "孩子们在草地上奔跑玩耍。", "老人们坐在长椅上聊天，今天很好。"])]
    docs = make_docs([(i, f"the dog number {i} and some thing that was clean{i} in every way") for i in range(100, 140)]).select(*corpus_pipeline.COLUMNS)
    first = corpus_pipeline.identify_language(spark, docs.unionByName(spark.createDataFrame(few, docs.schema)), SF)
    assert {0, 1, 2} <= {r.doc_id for r in first.collect()} and first.count() == 43


def test_one_row_of_a_group_without_own_ids_stays(spark, make_docs):
    words = [[f"w{g}x{i}" for i in range(80)] for g in range(4)]
    near = lambda g, i: " ".join([*words[g], f"end{i}"])
    docs = make_docs([(None, near(0, i)) for i in range(4)] + [(7, near(1, i)) for i in range(4)] + [(None, near(2, 0)), (3, near(2, 1))] + [
        (None, near(3, 0)), (None, None), (9, ""), (9, "own words")])
    rows = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()]
    groups = [[d for d, text in rows if text and text.startswith(f"w{g}x")] for g in range(4)]
    assert groups == [[None], [7], [3], [None]]
    assert {(None, None), (9, ""), (9, "own words")} <= set(rows) and len(rows) == 7


def test_mixing_and_packing_take_odd_rows(spark, make_docs):
    rows = [(1, "a b c"), (1, "a b c"), (2, None), (None, "no id"), (3, ""), *[(10 + i, f"text {i}", f"s{i % 3}") for i in range(40)]]
    docs = make_docs(rows).withColumns({"copies": F.lit("x"), "bucket": F.lit(1), "mix_key": F.lit(None)})
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    assert mixed.columns == corpus_pipeline.COLUMNS
    counts = {}
    for r in mixed.collect():
        counts[r.doc_id, r.text] = counts.get((r.doc_id, r.text), 0) + 1
    assert counts.get((1, "a b c"), 0) % 2 == 0 and set(counts) <= {(r[0], r[1]) for r in rows} and sum(counts.values()) > 40
    packed = corpus_pipeline.pack_batches(spark, mixed.withColumn("place", F.lit("x")), SF)
    assert packed.count() == sum(counts.values()) and len(set(packed.columns)) == len(packed.columns)
    none = docs.limit(0)
    assert corpus_pipeline.mix_sources(spark, none, SF).count() == 0 and corpus_pipeline.pack_batches(spark, none, SF).count() == 0
