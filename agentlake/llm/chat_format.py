"""Chat formatting: JSON records of many layouts -> canonical turns -> one
formatted training string per conversation with its loss mask.

The layout of a record is recognised by the *fingerprint* of its nested field
paths: the record's schema (object keys in order, arrays, no scalar types) is
hashed and looked up among the fingerprints of declared :class:`Layout` s. A
layout only declares where roles and texts stand; adding one needs no code.
Everything is a Catalyst expression; records are parsed before any shuffle, so
a conversation that holds a third of all rows is parsed by all tasks and met
again only as the one string it has to become.

Defined results: a null or unparsable record, or one whose fingerprint is not
declared, has layout null and no turns (``unmatched`` returns them); a null
text or role is an empty string; a null sequence number sorts first; equal
sequence numbers sort by the position in their record, then role, then text;
repeated rows are kept; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial, reduce
from itertools import chain, combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Part:
    """One turn of a layout (or one for each element of the array ``each``).
    ``role``: a constant; else ``role_path`` names the field. ``aliases`` maps
    the layout's role names to canonical ones, others stay as they are."""
    text_path: str
    role: str | None = None
    role_path: str | None = None
    each: str | None = None
    aliases: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Layout:
    name: str
    parts: tuple[Part, ...]
    #: Top-level fields that may be absent; every combination has its own fingerprint.
    optional: tuple[str, ...] = ()
    #: Top-level fields that carry no turn (ids, sources) and may be absent.
    ignored: tuple[str, ...] = ()


SHAREGPT = (("human", "user"), ("gpt", "assistant"))

LAYOUTS = (
    Layout("role_content", (Part("$.content", role_path="$.role"),), ignored=("id",)),
    Layout("from_value", (Part("$.value", role_path="$.from", aliases=SHAREGPT),), ignored=("id",)),
    Layout("author_parts", (Part("$.message.content.parts[0]", role_path="$.message.author.role"),)),
    Layout("messages", (Part("$.content", role_path="$.role", each="$.messages"),), ignored=("id", "source")),
    Layout("conversations", (Part("$.system", role="system"), Part("$.value", role_path="$.from", each="$.conversations", aliases=SHAREGPT)),
           optional=("system",), ignored=("id", "source")),
    Layout("prompt_completion", (Part("$.system", role="system"), Part("$.prompt", role="user"), Part("$.completion", role="assistant")),
           optional=("system", "completion"), ignored=("id",)),
    Layout("completion_only", (Part("$.completion", role="assistant"),)),
    Layout("instruction_output", (Part("$.system", role="system"), Part("$.instruction", role="user"), Part("$.output", role="assistant")),
           optional=("system", "output"), ignored=("id",)),
    Layout("instruction_input_output", (Part("$.instruction", role="user"), Part("$.input", role="user"), Part("$.output", role="assistant"))),
    Layout("output_only", (Part("$.output", role="assistant"),)),
    Layout("system_only", (Part("$.system", role="system"),)),
)

# Control strings of the template. No text holds any of them once escaped.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: A backslash after the first character breaks these, whichever template they belong to.
CONTROL = (("<|", "<\\|"), ("<s>", "<\\s>"), ("</s>", "<\\/s>"), ("[INST]", "[\\INST]"), ("[/INST]", "[\\/INST]"),
           ("<<SYS>>", "<\\<SYS>>"), ("<</SYS>>", "<\\</SYS>>"))


# -- fingerprints ---------------------------------------------------------------------------------------------------

def _shape(paths: list[str]) -> str:
    """The canonical text of a set of paths, as :func:`shape` reads it off a record."""
    tree: dict = {}
    for p in paths:
        node = tree
        for step in p.removeprefix("$.").replace("[0]", "[]").replace("[]", ".[]").split("."):
            node = node.setdefault(step, {})

    def text(node: dict) -> str:
        if not node:
            return "*"
        if "[]" in node:
            return f"ARRAY<{text(node['[]'])}>"
        return "OBJECT<" + ", ".join(f"{k}: {text(node[k])}" for k in sorted(node)) + ">"

    return text(tree)


def shapes(layout: Layout) -> list[str]:
    """Every shape of a layout: with and without each optional or ignored field."""
    paths = [p for part in layout.parts for p in (
        [f"{part.each}[]{q[1:]}" for q in (part.text_path, part.role_path) if q] if part.each else [q for q in (part.text_path, part.role_path) if q])]
    free = [*layout.optional, *layout.ignored]
    every = {*paths, *(f"$.{f}" for f in layout.ignored)}
    gone = chain.from_iterable(combinations(free, n) for n in range(len(free) + 1))
    return sorted({_shape([p for p in every if p[2:].split(".")[0].split("[")[0] not in g]) for g in gone})


def shape(record: Column) -> Column:
    """The nested field paths of a VARIANT record, without the scalar types."""
    schema = F.schema_of_variant(record)
    return F.regexp_replace(schema, r"\b(?:STRING|BIGINT|INT|SMALLINT|TINYINT|DECIMAL\([0-9]+,[ ]?[0-9]+\)|DOUBLE|FLOAT|BOOLEAN|VOID|VARIANT)(?=[,>]|$)", "*")


def fingerprint(record: Column) -> Column:
    return F.xxhash64(shape(record))


# -- records -> turns -------------------------------------------------------------------------------------------------

def _field(record: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(record, path, "string"), F.lit(""))


def _role(record: Column, part: Part) -> Column:
    if part.role is not None:
        return F.lit(part.role)
    role = _field(record, part.role_path)
    return reduce(lambda c, a: F.when(role == a[0], a[1]).otherwise(c), reversed(part.aliases), role) if part.aliases else role


def _turns(record: Column, layout: Layout) -> Column:
    def one(part: Part, rec: Column) -> Column:
        return F.struct(_role(rec, part).alias("role"), _field(rec, part.text_path).alias("text"))

    found = []
    for part in layout.parts:
        if part.each:
            items = F.try_variant_get(record, part.each, "array<variant>")
            found.append(F.transform(items, partial(one, part)))
        else:
            there = F.try_variant_get(record, part.text_path, "variant").isNotNull() if part.text_path[2:] in layout.optional else F.lit(True)
            found.append(F.when(there, F.array(one(part, record))).otherwise(F.array().cast("array<struct<role:string,text:string>>")))
    return F.concat(*found) if len(found) > 1 else found[0]


def _recognised(records: DataFrame, payload: str, layouts: tuple[Layout, ...]) -> DataFrame:
    """Adds __rec and __layout (null: unknown)."""
    spark = records.sparkSession
    forms = [(la.name, s) for la in layouts for s in shapes(la)]
    # The declared shapes are hashed by the same function as the records' shapes.
    prints = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.xxhash64(F.lit(s)).alias("print")) for n, s in forms]))).collect()
    out = records.withColumn("__rec", F.try_parse_json(payload)).withColumn("__print", fingerprint(F.col("__rec")))
    by_name = {la.name: [r["print"] for r in prints if r["name"] == la.name] for la in layouts}
    which = reduce(lambda c, la: F.when(F.col("__print").isin(by_name[la.name]), la.name).otherwise(c), reversed(layouts), F.lit(None).cast("string"))
    return out.withColumn("__layout", which)


def canonical_turns(records: DataFrame, conv: str = "conv_id", seq: str = "seq", payload: str = "payload",
                    layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(conv, seq, payload JSON) -> one row per turn: conv, seq, pos, layout, role, text."""
    known = _recognised(records.select(conv, seq, payload), payload, layouts).where(F.col("__layout").isNotNull())
    turns = reduce(lambda c, la: F.when(F.col("__layout") == la.name, _turns(F.col("__rec"), la)).otherwise(c), reversed(layouts),
                   F.lit(None).cast("array<struct<role:string,text:string>>"))
    return known.select(conv, F.col(seq).alias("seq"), F.col("__layout").alias("layout"), F.posexplode(turns).alias("pos", "turn")) \
        .select(conv, "seq", "pos", "layout", "turn.role", "turn.text")


def unmatched(records: DataFrame, payload: str = "payload", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """The records that no layout recognises, with their fingerprint (null: not JSON)."""
    cols = records.columns
    return _recognised(records, payload, layouts).where(F.col("__layout").isNull()).select(*cols, F.col("__print").alias("fingerprint"))


# -- turns -> formatted text ------------------------------------------------------------------------------------------

def escape(col: Column) -> Column:
    """Doubles backslashes, then puts one inside every control string."""
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), CONTROL, F.replace(col, F.lit("\\"), F.lit("\\\\")))


def unescape(col: Column) -> Column:
    return F.regexp_replace(col, r"(?s)\\(.)", "$1")


def format_conversations(turns: DataFrame, conv: str = "conv_id", trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Turns (conv, seq, pos, role, text) -> conv, formatted, turn_spans.

    ``formatted`` is TURN role TEXT text END for every turn. ``turn_spans`` has,
    in code points of ``formatted``, where each turn and its text start, the
    text's length, and whether the loss covers it. Starts are a running sum in
    a window, so building them is linear in the number of turns."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select(conv, "seq", "pos", role.alias("role"), text.alias("text"), role.isin(*trained).alias("loss"), escape(role).alias("r"), escape(text).alias("t"))
    rows = rows.withColumn("seg", F.concat(F.lit(TURN), "r", F.lit(TEXT), "t", F.lit(END))).withColumn("len", F.char_length("seg").cast("long"))
    order = Window.partitionBy(conv).orderBy("seq", "pos", "role", "text")
    rows = rows.withColumn("i", F.row_number().over(order)).withColumn(
        "start", F.sum("len").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("len"))
    head = F.lit(len(TURN) + len(TEXT)) + F.char_length("r")
    item = F.struct("i", "seg", "start", (F.col("start") + head).alias("text_start"), F.char_length("t").cast("long").alias("text_len"), "loss")
    return rows.groupBy(conv).agg(F.array_sort(F.collect_list(item)).alias("x")).select(
        conv, F.array_join(F.col("x.seg"), "").alias("formatted"),
        F.transform("x", lambda x: F.struct(x["start"].alias("start"), x["text_start"].alias("text_start"), x["text_len"].alias("text_len"), x["loss"].alias("loss"))).alias("turn_spans"))


def read_back(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """formatted, turn_spans -> conv, turns array<struct<role, text>>, loss_text
    (all text under the loss mask, unescaped), formatted_chars."""
    segs = F.slice(F.split("formatted", F.lit(_quoted(TURN))), F.lit(2), F.size("turn_spans"))
    one = lambda s: F.struct(
        unescape(F.substring_index(s, TEXT, 1)).alias("role"),
        unescape(F.substring_index(F.substring_index(s, TEXT, -1), END, 1)).alias("text"))
    # A turn's own segment is cut at offsets relative to it: cutting the whole
    # string at absolute offsets would read it from its start for every turn.
    masked = F.zip_with(segs, "turn_spans", lambda s, m: F.when(
        m["loss"], unescape(F.substring(s, (m["text_start"] - m["start"] - len(TURN) + 1).cast("int"), m["text_len"].cast("int")))).otherwise(""))
    return formatted.select(conv, F.transform(segs, one).alias("turns"), F.array_join(masked, "").alias("loss_text"),
                            F.char_length("formatted").cast("long").alias("formatted_chars"))


def _quoted(s: str) -> str:
    return s.replace("|", "\\|")
