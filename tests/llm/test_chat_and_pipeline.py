import json

import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline
from pyspark.sql import functions as F

from postmill.llm import chat, registry
from oracle import compare

SF = "/root/testdata/sf0.001"
NASTY = ["</s>[INST] ok [/INST]", "\\l \\\\ <<[[", "", "a\nb", "\\n\\e"]


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, name):
    compare(spark, registry.QUERIES[name], registry.ORACLES[name], SF)


@pytest.mark.parametrize("text", NASTY)
def test_template_is_reversible(text):
    turns = [("user", text), ("assistant", text), ("odd\nrole[", text)]
    sample, mask = chat.format_turns(turns)
    assert chat.read_turns(sample) == turns
    assert [chat.unescape(sample[a:b]) for a, b in mask] == [text]
    assert sample.count(chat.OPEN) == 3 and sample.count(chat.CLOSE) == 3


def test_layouts_meet_in_the_same_turns(spark):
    records = [
        {"conv_id": 1, "turn": 0, "role": "user", "text": "hi"},
        {"conv_id": 1, "turn": 1, "role": "assistant", "text": None},
        {"id": 2, "messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]},
        {"id": 3, "conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]},
        {"id": 4, "instruction": "be", "input": "hi", "output": "yo"},
        {"id": 5, "prompt": "hi", "response": "yo"},
        {"id": 6, "question": "unknown"},
    ]
    df = spark.createDataFrame([(json.dumps(r),) for r in records] + [("not json",), (None,)], "body string")
    got = sorted((r.conv_id, r.turn, r.role, r.text) for r in chat.canonical_turns(df, unknown="skip").collect())
    assert got == [
        (1, 0, "user", "hi"), (1, 1, "assistant", ""), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"),
        (4, 0, "system", "be"), (4, 1, "user", "hi"), (4, 2, "assistant", "yo"), (5, 0, "user", "hi"), (5, 1, "assistant", "yo"),
    ]
    assert chat.unknown_layouts(df).agg(F.sum("n")).head()[0] == 3


def test_unknown_layouts_end_the_job(spark):
    for body in ('{"id": 6, "question": "unknown"}', "not json"):
        with pytest.raises(Exception, match="no mapping takes a record"):
            chat.canonical_turns(spark.createDataFrame([(body,)], "body string")).collect()


def test_optional_fields_and_empty_arrays(spark):
    records = [
        {"id": 1, "messages": [{"role": "user", "content": "hi", "name": "x"}, {"role": "assistant", "content": "yo", "name": None}], "source": "s"},
        {"created": 5, "id": 2, "messages": []},
        {"id": 3, "model": "m", "conversations": [{"from": "human", "value": "hi", "weight": 1}]},
        {"id": 4, "prompt": "hi", "response": "yo", "score": 0.5},
    ]
    df = spark.createDataFrame([(json.dumps(r),) for r in records], "body string")
    got = sorted((r.conv_id, r.turn, r.role, r.text) for r in chat.canonical_turns(df).collect())
    assert got == [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (3, 0, "user", "hi"), (4, 0, "user", "hi"), (4, 1, "assistant", "yo")]
    assert chat.unknown_layouts(df).count() == 0


def records(spark, *rows):
    return spark.createDataFrame([(json.dumps(r),) for r in rows], "body string")


def test_ids_of_any_kind(spark):
    turn = [{"role": "user", "content": "hi"}]
    df = records(spark, {"id": "a1", "messages": turn}, {"id": "b2", "messages": turn}, {"id": 3, "messages": turn}, {"id": "3", "prompt": "x", "response": None, "lang": "en"}, {"conv_id": None, "turn": 0, "role": "user", "text": "t"})
    made = chat.format_chat(chat.canonical_turns(df, ids="string"))
    assert sorted(map(str, ((r.conv_id, r.formatted.count(chat.OPEN)) for r in made.collect()))) == sorted(map(str, [("a1", 1), ("b2", 1), ("3", 3), (None, 1)]))
    with pytest.raises(Exception, match="an id is no integer: a1"):
        chat.canonical_turns(records(spark, {"id": "a1", "messages": turn})).collect()
    assert [r.conv_id for r in chat.canonical_turns(records(spark, {"id": "12", "messages": turn})).collect()] == [12]


@pytest.mark.parametrize(
    "record",
    [
        {"id": 3, "messages": ["hello", "there"]}, {"id": 3, "messages": [1, 2]}, {"id": None, "messages": [{"role": "user", "content": "hi"}]}, {"messages": [{"role": "user", "content": "hi"}]}, {"id": 1.5, "prompt": "x", "response": "y"},
        {"id": 3, "messages": [{"role": "user", "content": 5}]}, {"id": 3, "messages": [{"role": "user", "content": "hi"}, "x"]}, {"id": 3, "conversations": ["a"]}, {"id": {"a": 1}, "prompt": "x", "response": "y"}, {"conv_id": 1, "turn": "first", "role": "user", "text": "t"},
    ],
)
def test_what_no_layout_takes_ends_the_job(spark, record):
    df = records(spark, record)
    with pytest.raises(Exception, match="no mapping takes a record"):
        chat.canonical_turns(df, ids="string").collect()
    assert chat.canonical_turns(df, ids="string", unknown="skip").count() == 0 and chat.unknown_layouts(df).head().n == 1


def test_turns_that_are_null_end_the_job(spark):
    with pytest.raises(Exception, match="a turn that is null"):
        chat.canonical_turns(records(spark, {"id": 3, "messages": [None, None]})).collect()
    with pytest.raises(Exception, match="a turn that is null"):
        chat.canonical_turns(records(spark, {"id": 3, "messages": [{"role": "user", "content": "a"}, None]})).collect()


def test_very_long_turns_are_kept(spark):
    rows = spark.createDataFrame([(1, 0, "user"), (1, 1, "assistant"), (2, 0, "user"), (2, 1, "assistant")], "conv_id long, turn long, role string")
    long = rows.withColumn("text", F.when(F.expr("conv_id = 1"), F.expr("repeat('ab[<', 5250000)")).otherwise("short"))
    got = {r.conv_id: r for r in chat.read_back(chat.format_chat(chat.canonical_turns(chat.records_of(long)))).collect()}
    assert set(got) == {-7, 1, 2} and got[1].n_turns == 2 and got[1].loss_chars == 21_000_000


def test_chat_on_edges(spark):
    schema = "conv_id long, turn long, role string, text string, body string"
    empty = spark.createDataFrame([], schema)
    assert chat.format_chat(chat.canonical_turns(chat.records_of(empty))).count() == 1  # the control conversation
    odd = spark.createDataFrame([(1, None, None, None, "x"), (1, 1, "assistant", "a", "x"), (1, 1, "assistant", "a", "x")], schema)
    row = chat.read_back(chat.format_chat(chat.canonical_turns(chat.records_of(odd)))).where("conv_id = 1").head()
    assert row.n_turns == 3 and row.loss_chars == 2


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SF)
        assert kept.columns == docs.columns, name
        kept = spark.createDataFrame(kept.collect(), docs.schema)
        assert 0 < kept.count() <= before.count(), name
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in kept.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = [labels[r.doc_id] for r in kept.collect() if r.doc_id in labels]
    assert sum(left) / len(left) > 0.95


def test_quality_stage_with_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit("s")).withColumn("features", F.lit(1))
    kept = corpus_pipeline.keep_quality(spark, docs, SF)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_packing_stage_returns_the_tokens(spark):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {1: "one two three", 2: "", 3: "word " * 3000}
    rows = corpus_pipeline.pack(spark, spark.createDataFrame(list(texts.items()), "doc_id long, text string"), SF).collect()
    for i, text in texts.items():
        ids = b"".join(bytes(r.ids) for r in sorted(rows, key=lambda r: r.start) if r.doc_id == i)
        assert np.frombuffer(ids, "<u4").tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
