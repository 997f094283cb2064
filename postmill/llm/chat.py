"""Operator 2, chat formatting with schema fingerprints.

Records arrive as JSON text or as variants, in whatever layout their source
uses.  A record's fingerprint is the hash of its nested field paths and of the
kinds of their scalars (integer, string, null, other), optional fields left out;
a small declarative table maps fingerprints to the fields that make turns, so
that a new layout is a new row of that table, not new code.  Each matched record
becomes canonical turns (conv_id, turn, role, text), and a conversation's
turns become one training sample in the template

    <s>[INST] role
    text[/INST]</s>

once per turn, in which a role's or text's ``\\``, ``<`` and ``[`` are written
``\\e``, ``\\l`` and ``\\b`` (and a role's line break ``\\n``), so that no text
can spell a marker and the escape is reversible.  The loss mask is the list of
code-point spans that hold the (escaped) assistant texts.

Conversations are gathered by one shuffle on conv_id.  A sample is one value,
so a conversation is what one task holds at a time.

Defined results: null texts and roles count as empty; turns are ordered by
their number (null first), then role, then text; repeated rows repeat their
turns; a record of an unknown layout, or whose JSON cannot be read (such as one
with a string beyond the reader's 20 million characters, which as a variant
is no limit), ends the job with an error unless the caller asks to skip such
records, and ``unknown_layouts`` counts them (a record whose turns are texts or
numbers instead of objects, or that lacks the id that its layout asks for, is of
an unknown layout); a record with an empty array of turns has none, one with a
turn that is null ends the job; ids are integers, or texts where ``ids`` asks for
them (an integer and the text of its digits are then one id), and a text where
integers are asked for ends the job; rows with a null conv_id are one conversation; a text may be as
long as a variant, 128 MB, and longer ones end the job; an empty table gives an
empty result; further columns of the conversations table are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.shared import bounded_batches

OPEN, CLOSE = "<s>[INST] ", "[/INST]</s>"

#: Declarative mappings by shape: field names in order, the kinds of scalar that
#: each may hold (n: integer, s: string, v: null), then the conversation's id and
#: either one turn per record, an array of turns, or single fields with their
#: roles in order.  Only a turn's record may lack an id; ``ARRAY<v>`` is an array
#: without turns.
LAYOUTS = (
    {"shape": "OBJECT<conv_id: nsv, role: sv, text: sv, turn: nv>", "id": "conv_id", "turn": "turn", "role": "role", "text": "text"},
    {"shape": "OBJECT<id: ns, messages: ARRAY<OBJECT<content: sv, role: sv>>>", "id": "id", "array": "messages", "role": "role", "text": "content"},
    {"shape": "OBJECT<conversations: ARRAY<OBJECT<from: sv, value: sv>>, id: ns>", "id": "id", "array": "conversations", "role": "from", "text": "value"},
    {"shape": "OBJECT<id: ns, messages: ARRAY<v>>", "id": "id", "array": "messages", "role": "role", "text": "content"},
    {"shape": "OBJECT<conversations: ARRAY<v>, id: ns>", "id": "id", "array": "conversations", "role": "from", "text": "value"},
    {"shape": "OBJECT<id: ns, input: sv, instruction: sv, output: sv>", "id": "id", "fields": (("system", "instruction"), ("user", "input"), ("assistant", "output"))},
    {"shape": "OBJECT<id: ns, prompt: sv, response: sv>", "id": "id", "fields": (("user", "prompt"), ("assistant", "response"))},
)

#: Scalar fields that a record or a turn may carry besides those of its layout.
OPTIONAL = ("created", "created_at", "lang", "language", "metadata", "model", "name", "rating", "score", "source", "split", "timestamp", "weight")

#: Names of the same role in the layouts that have their own.
ROLES = {"human": "user", "gpt": "assistant"}

_TYPE = r"(?<=[:<] ?)(?:{})(?=[,>])"
_KINDS = (("n", r"BIGINT|DECIMAL\(\d+, ?0\)"), ("s", "STRING"), ("v", "VOID"), ("x", r"DOUBLE|FLOAT|BOOLEAN|DATE|TIMESTAMP|TIMESTAMP_NTZ|BINARY|VARIANT|DECIMAL\(\d+, ?\d+\)"))


def fingerprints_of(shape: str) -> list[str]:
    """The fingerprints of all records that a layout's shape allows."""
    parts = re.split(r"(?<=[:<])( ?)([nsvx]+)(?=[,>])", shape)
    fixed, kinds = parts[::3], parts[2::3]
    gaps = parts[1::3]
    shapes = ("".join(x for i, k in enumerate(some) for x in (fixed[i], gaps[i], k)) + fixed[-1] for some in itertools.product(*kinds))
    return [hashlib.sha256(x.encode()).hexdigest()[:16] for x in shapes]


def with_fingerprint(records: DataFrame, body: str = "body") -> DataFrame:
    """``records`` with ``record``, a variant (parsed from ``body`` where the
    table has none), and its ``fingerprint``: nested field paths and the kinds of
    their scalars, hashed."""
    if dict(records.dtypes).get("record") != "variant":
        records = records.withColumn("record", F.try_parse_json(F.col(body)))
    names = "|".join(OPTIONAL)
    shape = F.schema_of_variant("record")
    for kind, types in _KINDS:
        shape = F.regexp_replace(shape, _TYPE.format(types), kind)
    shape = F.regexp_replace(shape, rf"(?<=<)((?:{names}): [nsvx], )+|(, (?:{names}): [nsvx])+(?=[,>])", "")
    return records.withColumn("fingerprint", F.left(F.sha2(shape, 256), F.lit(16)))


_TURNS = "array<struct<turn:bigint,role:string,text:string>>"


def _mapped(layout: dict):
    """The layout's turns as array<struct<turn, role, text>>."""
    get = lambda path, kind: F.try_variant_get("record", f"$.{path}", kind)
    turn = lambda n, role, text: F.struct(n.cast("long").alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    if "fields" in layout:
        return F.array(*(turn(F.lit(i), F.lit(role), get(field, "string")) for i, (role, field) in enumerate(layout["fields"])))
    if "array" in layout:
        items = get(layout["array"], f"array<struct<{layout['role']}:string,{layout['text']}:string>>")
        lost = F.raise_error(F.lit("a record has a turn that is null")).cast(_TURNS)
        return F.when(items.isNull() | F.exists(items, lambda x: x.isNull()), lost).otherwise(F.transform(items, lambda x, i: turn(i, x[layout["role"]], x[layout["text"]])))
    return F.array(turn(get(layout["turn"], "long"), get(layout["role"], "string"), get(layout["text"], "string")))


def _id_of(layout: dict, kind: str):
    """The conversation's id; one that is there but is not of the kind ends
    the job, as it would otherwise be lost."""
    value, text = (F.try_variant_get("record", f"$.{layout['id']}", k) for k in (kind, "string"))
    lost = F.raise_error(F.concat(F.lit("an id is no integer: "), text, F.lit("; ask for ids as strings"))).cast(kind)
    return F.when(value.isNull() & text.isNotNull(), lost).otherwise(value)


def canonical_turns(records: DataFrame, layouts: tuple = LAYOUTS, body: str = "body", unknown: str = "error", ids: str = "long") -> DataFrame:
    """conv_id, turn, role, text of every record.  ``unknown``: "error" or
    "skip", what happens at a record whose layout no mapping takes; ``ids``:
    "long", or "string" where some ids are no integers."""
    if unknown not in ("error", "skip") or ids not in ("long", "string"):
        raise ValueError("unknown is error or skip, ids are long or string")
    known = with_fingerprint(records, body)
    name = F.coalesce("fingerprint", F.lit("unreadable"))
    turns = F.lit(None).cast(_TURNS) if unknown == "skip" else F.raise_error(F.concat(F.lit("no mapping takes a record of the layout "), name)).cast(_TURNS)
    conv = F.lit(None).cast(ids)
    for layout in layouts:
        same = F.col("fingerprint").isin(fingerprints_of(layout["shape"]))
        renamed = _mapped(layout)
        if layout.get("role") == "from":
            names = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
            renamed = F.transform(renamed, lambda t: t.withField("role", F.coalesce(F.element_at(names, t["role"]), t["role"])))
        turns = F.when(same, renamed).otherwise(turns)
        conv = F.when(same, _id_of(layout, ids)).otherwise(conv)
    return known.select(conv.alias("conv_id"), F.explode(turns).alias("t")).select("conv_id", "t.turn", "t.role", "t.text")


def unknown_layouts(records: DataFrame, layouts: tuple = LAYOUTS, body: str = "body") -> DataFrame:
    """fingerprint, n of the records that no mapping takes."""
    known = [f for x in layouts for f in fingerprints_of(x["shape"])]
    print_of = F.coalesce("fingerprint", F.lit("unreadable"))
    return with_fingerprint(records, body).select(print_of.alias("fingerprint")).where(~F.col("fingerprint").isin(known)).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"))


def escape(text: str) -> str:
    return text.replace("\\", "\\e").replace("<", "\\l").replace("[", "\\b")


def unescape(text: str) -> str:
    return text.replace("\\b", "[").replace("\\l", "<").replace("\\n", "\n").replace("\\e", "\\")


def format_turns(turns: list[tuple[str, str]], learned: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The sample of (role, text) turns and its loss mask."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        head = OPEN + escape(role).replace("\n", "\\n") + "\n"
        body = escape(text)
        parts += [head, body, CLOSE]
        if role == learned:
            mask.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), mask


def read_turns(sample: str) -> list[tuple[str, str]]:
    """The turns of a formatted sample."""
    out = []
    for stretch in sample.split(CLOSE)[:-1]:
        role, _, text = stretch[len(OPEN) :].partition("\n")
        out.append((unescape(role), unescape(text)))
    return out


def format_chat(turns: DataFrame) -> DataFrame:
    """conv_id (of the turns' type), formatted, loss_mask (array of start, stop)
    per conversation."""
    kind = dict(turns.dtypes)["conv_id"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                made = [format_turns([(t["role"], t["text"]) for t in c]) for c in part.column("turns").to_pylist()]
                mask = [[{"start": a, "stop": b} for a, b in m] for _, m in made]
                yield pa.RecordBatch.from_arrays([part.column("conv_id"), pa.array([f for f, _ in made], pa.string()), pa.array(mask, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))], ["conv_id", "formatted", "loss_mask"])

    gathered = bounded_batches(turns).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return gathered.mapInArrow(rows, f"conv_id {kind}, formatted string, loss_mask array<struct<start: long, stop: long>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what a trainer would read from the samples: conv_id,
    n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for sample, mask in zip(batch.column("formatted").to_pylist(), batch.column("loss_mask").to_pylist()):
                turns = read_turns(sample)
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                loss = "".join(unescape(sample[m["start"] : m["stop"]]) for m in mask)
                digest = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((len(turns), digest(whole), len(loss), digest(loss), len(sample)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], names)

    schema = f"conv_id {dict(formatted.dtypes)['conv_id']}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = [x.split()[0] for x in schema.split(", ")]
    return formatted.mapInArrow(rows, schema)


CONTROL = "</s>[INST] ok [/INST]"


def records_of(conversations: DataFrame) -> DataFrame:
    """The conversations table as records (variants) in the layouts that such
    data comes in: question and answer as prompt and response, three turns with
    a system text as instruction, others as arrays of turns under either naming,
    the control conversation -7 and rows without an id as a record per turn."""
    table = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    control = conversations.sparkSession.createDataFrame([(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    single = table.where("conv_id IS NULL").unionByName(control)
    turns = table.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))

    t, roles = F.col("t"), F.transform("t", lambda x: F.coalesce(x["role"], F.lit("")))
    same = lambda *names: roles == F.array(*map(F.lit, names))
    # every third id is a text, every fifth record has fields that no layout needs
    extra = (F.lit("en").alias("lang"), F.lit(0.5).alias("score"))

    def record(*fields):
        made = lambda ident, more: F.to_variant_object(F.struct(ident.alias("id"), *fields, *more))
        number, words, more = F.col("conv_id"), F.col("conv_id").cast("string"), F.col("conv_id") % 5 == 0
        return F.when(F.col("conv_id") % 3 == 1, F.when(more, made(words, extra)).otherwise(made(words, ()))).otherwise(F.when(more, made(number, extra)).otherwise(made(number, ())))

    text = lambda i, name: t[i]["text"].alias(name)
    given = F.create_map(F.lit("user"), F.lit("human"), F.lit("assistant"), F.lit("gpt"), F.lit("system"), F.lit("system"))
    whole = (
        F.when(same("user", "assistant"), record(text(0, "prompt"), text(1, "response")))
        .when(same("system", "user", "assistant"), record(text(0, "instruction"), text(1, "input"), text(2, "output")))
        .when((F.col("conv_id") % 2 == 0) & F.forall(roles, lambda r: r.isin("user", "assistant", "system")), record(F.transform(t, lambda x: F.struct(given[x["role"]].alias("from"), x["text"].alias("value"))).alias("conversations")))
        .otherwise(record(F.transform(t, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages")))
    )
    rows = single.select(F.to_variant_object(F.struct("conv_id", "role", "text", "turn")).alias("record"))
    return turns.select(whole.alias("record")).unionByName(rows)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = canonical_turns(records_of(spark.read.parquet(f"{sf_dir}/conversations.parquet")), ids="string")
    return read_back(format_chat(turns)).withColumn("conv_id", F.col("conv_id").cast("long"))


OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(role) + length(text) + len(regexp_extract_all(role || text, '[\\<\[]')) + len(regexp_extract_all(role, '\n')) AS escaped FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(escaped + 22) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
