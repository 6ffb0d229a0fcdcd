"""Chat formatting: layouts told apart by a hash of their nested field paths, mapped to canonical turns, then marked up.

A record is a VARIANT. Its layout is the tree of its field names and arrays without the scalars'
types; the tree's 64-bit hash picks a declared mapping, and the mappings are Column expressions, so
everything stays in built-in functions. Each turn becomes one marked-up chunk; a conversation is its
chunks in order. Inside chunks '&' and '<' are written as entities, which read back without loss, so
no text can hold a control string.

Defined results: null text or role counts as empty. Turns are ordered by number (null first), then
role, then text, so ties have an order; repeated rows are repeated turns. Rows with a null id form one
conversation. A record whose layout is not declared, or that is null, is one turn of the role UNMAPPED
that holds the record as JSON (null: empty), with a null `layout`; so is one whose list of messages is
empty or does not read as one. `unmapped` counts their shapes. An empty table gives an empty one; extra
columns of the turn table are kept, but those named like a result give way to it. One conversation is one
result row, however long: its chunks meet in one task only when it is assembled.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<ord: bigint, role: string, text: string>>"
SCALAR = r"(STRING|BIGINT|DOUBLE|FLOAT|BOOLEAN|VOID|BINARY|UUID|DATE|TIMESTAMP_NTZ|TIMESTAMP|DECIMAL\(\d+,\s*\d+\))(?=[,>]|$)"
OPEN, MIDDLE, CLOSE = '<turn role="', '">', "</turn>\n"
TRAINED = "assistant"
#: The role of a record whose layout is not declared; it is never under the loss mask.
UNMAPPED = "unmapped"
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """paths: every leaf, arrays as `name[]`; any of `optional` may come beside them. Either a list of messages (at, role, text, [order]) or fixed turns (role, fields joined by a blank line)."""

    name: str
    paths: tuple[str, ...]
    at: str = ""
    role: str = ""
    text: str = ""
    order: str = ""
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    optional: tuple[str, ...] = ("id",)

    def shapes(self) -> list[str]:
        """Of the paths with every choice of the optional ones."""
        return [shape_of(self.paths + some) for n in range(len(self.optional) + 1) for some in combinations(self.optional, n)]

    def turns(self, v: Column) -> Column:
        get = lambda field: F.try_variant_get(v, f"$.{field}", "string")
        if self.fixed:
            pieces = [F.struct(F.lit(i).cast("long").alias("ord"), F.lit(role).alias("role"), F.array_join(F.filter(F.array(*map(get, fields)), lambda x: x != ""), "\n\n").alias("text"), F.lit(fields == ("system",)).alias("optional")) for i, (role, fields) in enumerate(self.fixed)]
            told = F.filter(F.array(*pieces), lambda t: ~t["optional"] | (t["text"] != ""))
            return F.transform(told, lambda t: F.struct(t["ord"].alias("ord"), t["role"].alias("role"), t["text"].alias("text")))
        named = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
        role = lambda x: F.coalesce(named[F.lower(x)], x, F.lit(""))
        if not self.at:  # the record is one turn, in roles of ours
            order = F.try_variant_get(v, f"$.{self.order}", "long")
            return F.array(F.struct(order.alias("ord"), F.coalesce(get(self.role), F.lit("")).alias("role"), F.coalesce(get(self.text), F.lit("")).alias("text")))
        each = F.try_variant_get(v, f"$.{self.at}", f"array<struct<{self.role}: string, {self.text}: string>>")
        return F.transform(each, lambda m, i: F.struct(i.cast("long").alias("ord"), role(m[self.role]).alias("role"), F.coalesce(m[self.text], F.lit("")).alias("text")))


LAYOUTS = (
    Layout("turn rows", ("conv_id", "role", "text", "turn"), role="role", text="text", order="turn", optional=()),
    Layout("messages", ("messages[].content", "messages[].role"), at="messages", role="role", text="content", optional=("id", "messages[].name", "source")),
    Layout("conversations", ("conversations[].from", "conversations[].value"), at="conversations", role="from", text="value", optional=("id", "source")),
    Layout("prompt and response", ("prompt", "response"), fixed=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("prompt and completion", ("completion", "prompt"), fixed=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("instruction", ("input", "instruction", "output"), fixed=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("instruction alone", ("instruction", "output"), fixed=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("question and answer", ("answer", "question"), optional=("id", "system"), fixed=(("system", ("system",)), ("user", ("question",)), ("assistant", ("answer",)))),
)


def shape_of(paths: tuple[str, ...]) -> str:
    """The tree that schema_of_variant would show for paths, scalars as `_`."""
    heads: dict[str, list[str]] = {}
    for p in paths:
        head, _, rest = p.partition(".")
        heads.setdefault(head, []).extend([rest] if rest else [])
    field = lambda head, rests: (f"{head[:-2]}: ARRAY<{shape_of(tuple(rests)) if rests else '_'}>" if head.endswith("[]") else f"{head}: {shape_of(tuple(rests)) if rests else '_'}")
    return f"OBJECT<{', '.join(field(h, heads[h]) for h in sorted(heads))}>"


def fingerprint(shape: Column) -> Column:
    return F.xxhash64(shape)


def shape(record: Column) -> Column:
    return F.regexp_replace(F.schema_of_variant(record), SCALAR, "_")


def canonical_turns(records: DataFrame, key: str, record: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(key, layout, ord, role, text) of every turn of every record; layout: the name of the mapping, null for what none fits."""
    told = records.select(F.col(key), F.col(record).alias("_v"), fingerprint(shape(F.col(record))).alias("_f"))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for layout in layouts:
        fits = F.col("_f").isin([fingerprint(F.lit(x)) for x in layout.shapes()])
        name, turns = F.when(fits, F.lit(layout.name)).otherwise(name), F.when(fits, layout.turns(F.col("_v"))).otherwise(turns)
    whole = F.array(F.struct(F.lit(None).cast("long").alias("ord"), F.lit(UNMAPPED).alias("role"), F.coalesce(F.to_json("_v"), F.lit("")).alias("text")))
    found = F.size(F.coalesce(turns, F.array().cast(TURNS))) > 0
    told = told.select(key, F.when(found, name).alias("layout"), F.explode(F.when(found, turns).otherwise(whole)).alias("_t"))
    return told.select(key, "layout", "_t.*")


def unmapped(records: DataFrame, record: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(shape, n) of the records that no layout fits."""
    known = [x for layout in layouts for x in layout.shapes()]
    found = records.select(F.coalesce(shape(F.col(record)), F.lit("null")).alias("shape"))
    return found.where(~F.col("shape").isin(known)).groupBy("shape").agg(F.count("*").alias("n"))


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(c: Column) -> Column:
    """Each '&' of an escaped text begins an entity, so the order of replacing, '&amp;' last, is safe."""
    c = F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&quot;"), F.lit('"'))
    return F.replace(c, F.lit("&amp;"), F.lit("&"))


def chat_format(turns: DataFrame) -> DataFrame:
    """turns (role, text and more) with `chunk`, and where in the chunk the loss mask is on: `loss_from` and `loss_chars` (code points; null: nowhere)."""
    role = F.replace(escape(F.col("role")), F.lit('"'), F.lit("&quot;"))
    head = F.concat(F.lit(OPEN), role, F.lit(MIDDLE))
    body = escape(F.col("text"))
    on = F.col("role") == TRAINED
    made = {"chunk": F.concat(head, body, F.lit(CLOSE)), "loss_from": F.when(on, F.length(head)), "loss_chars": F.when(on, F.length(body))}
    return turns.select(*[F.col(f"`{c}`") for c in turns.columns if c.lower() not in made], *[c.alias(name) for name, c in made.items()])


def chunk_role(chunk: Column) -> Column:
    return unescape(F.regexp_extract(chunk, f'^{OPEN}([^"]*){MIDDLE}', 1))


def chunk_text(chunk: Column) -> Column:
    start = F.locate(MIDDLE, chunk) + len(MIDDLE)
    return unescape(F.substring(chunk, start, F.length(chunk) - len(CLOSE) - start + 1))


def conversations(chunks: DataFrame, key: str) -> DataFrame:
    """key, and the chunks of its conversation in order, as an array of (ord, role, text order keys, chunk, loss_from, loss_chars)."""
    return chunks.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("ord", "role", "text", "chunk", "loss_from", "loss_chars"))).alias("chunks"))


def chat_report(chunks: DataFrame, key: str) -> DataFrame:
    """Digests per conversation, read back from its chunks and their masks alone."""
    chunk = F.col("chunk")
    loss = unescape(F.substring(chunk, F.col("loss_from") + 1, F.col("loss_chars")))
    back = chunks.select(key, "ord", F.struct(chunk_role(chunk).alias("role"), chunk_text(chunk).alias("text"), F.coalesce(loss, F.lit("")).alias("loss"), F.length(chunk).cast("long").alias("n")).alias("b"))
    rows = back.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("ord", "b"))).alias("t"), F.count("*").alias("n_turns"), F.sum("b.n").alias("formatted_chars"))
    said = F.array_join(F.transform("t", lambda x: F.concat(x["b"]["role"], F.lit("\n"), x["b"]["text"], F.lit("\n"))), "")
    lost = F.array_join(F.transform("t", lambda x: x["b"]["loss"]), "")
    return rows.select(key, "n_turns", F.sha2(said, 256).alias("turns_sha256"), F.length(lost).cast("long").alias("loss_chars"), F.sha2(lost, 256).alias("loss_sha256"), "formatted_chars")
