"""Chat formatting by schema fingerprinting.

The nested field paths of a record (``messages[].role``, ``prompt``) are hashed to a fingerprint; a table of declarative
layouts, keyed by fingerprint, says where the turns are. Records are JSON texts, read with the layouts' fields and
without a limit on lengths, or structs, whose paths are those of their type. Canonical turns are rendered with a template
whose marks cannot occur inside the escaped texts, so the output can be read back.

Rows of one turn each (``format_rows``) are canonicalised, escaped and measured one by one; places in the conversation
come from a running sum, and only the finished pieces of a conversation meet in one value.

Defined results: a record that is null, no JSON or of an unknown layout stays, with null ``layout`` and ``turns``
and null output; null or missing texts and roles are empty; a text that is a list or an object in its record is its JSON
text; an empty message list gives no turns and an empty output. Rows go by turn (null first), then role and text;
repeated rows stay; a null conv_id is a conversation too. A conversation's output is one value, so it has to fit one
(2 GB). Columns besides the record's are passed through; the operator's own columns replace ones of the same name.
DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import chain, combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<role:string,text:string>>"
START, END = "<|im_start|>", "<|im_end|>\n"
#: JSON texts are read whatever their strings' lengths and depth.
NO_LIMIT = {"maxStringLen": "2147483647", "maxNestingDepth": "1000000"}


@dataclass(frozen=True)
class Layout:
    """Where a record keeps its turns: one list of messages, one field for each turn, or the fields of a single turn."""

    name: str
    array: str = ""  # JSON path of the list of messages
    role: str = ""  # field of a message, or of the record if it is a turn
    text: str = ""
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()  # (role, fields joined by a blank line)
    optional: tuple[str, ...] = ()  # top-level fields that may be absent
    aliases: dict[str, str] = field(default_factory=dict)  # role in the record -> canonical role

    def shapes(self) -> list[list[str]]:
        """The field paths this layout fits, one list for each choice of optional fields."""
        spare = list(chain.from_iterable(combinations(self.optional, n) for n in range(len(self.optional) + 1)))
        if self.array:  # an empty list tells nothing of its messages' fields
            bases = [[f"{self.array}[]", f"{self.array}[].{self.role}", f"{self.array}[].{self.text}"], [f"{self.array}[]"]]
        elif self.turns:
            bases = [[name for _, names in self.turns for name in names if name not in self.optional]]
        else:
            bases = [[self.role, self.text]]
        return [[*base, *more] for base in bases for more in spare]


#: The layouts known by default.
LAYOUTS = (
    Layout("messages", array="messages", role="role", text="content", optional=("id", "source")),
    Layout("conversations", array="conversations", role="from", text="value", optional=("id", "source"),
           aliases={"human": "user", "gpt": "assistant", "bot": "assistant"}),
    Layout("dialog", array="dialog", role="speaker", text="text", optional=("id", "source")),
    Layout("prompt_response", turns=(("user", ("prompt",)), ("assistant", ("response",))), optional=("id", "source")),
    Layout("prompt_completion", turns=(("user", ("prompt",)), ("assistant", ("completion",))), optional=("id", "source")),
    Layout("question_answer", turns=(("user", ("question",)), ("assistant", ("answer",))), optional=("id", "source")),
    Layout("instruction", turns=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))),
           optional=("id", "input", "source", "system")),
    Layout("turn", role="role", text="text", optional=("id", "source")),
)


def typed_paths(kind: T.DataType, at: str = "") -> list[str]:
    """The nested field paths of a type."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in typed_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        inner = typed_paths(kind.elementType, f"{at}[]")
        return inner if inner == [f"{at}[]"] else [f"{at}[]", *inner]
    return [at]


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(F.array_join(F.array_sort(F.array_distinct(paths)), "\n"))


def _json_record(record: Column, layouts: tuple[Layout, ...]) -> tuple[Column, dict[str, Column], Column]:
    """A JSON text's top-level fields as texts, its lists of messages as maps, and its field paths."""
    lists = sorted({layout.array for layout in layouts if layout.array})
    top = F.from_json(record, "map<string,string>", NO_LIMIT)
    held = F.from_json(record, "struct<" + ",".join(f"`{name}`:array<map<string,string>>" for name in lists) + ">", NO_LIMIT)
    arrays, paths = {name: held[name] for name in lists}, [F.filter(F.map_keys(top), lambda k: ~k.isin(lists))]
    for name, found in arrays.items():
        paths.append(F.when(found.isNotNull(), _inner_paths(found, name)).when(F.map_contains_key(top, name), F.array(F.lit(name))).otherwise(F.array().cast("array<string>")))
    return top, arrays, F.when(top.isNotNull(), F.flatten(F.array(*paths)))


def _inner_paths(found: Column, name: str) -> Column:
    keys = F.array_distinct(F.flatten(F.transform(F.filter(found, lambda m: m.isNotNull()), F.map_keys)))
    return F.concat(F.array(F.lit(f"{name}[]")), F.transform(keys, lambda k: F.concat(F.lit(f"{name}[]."), k)))


def canonical_turns(df: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Adds ``fingerprint``, ``layout`` and ``turns`` (array of role and text) to records, JSON texts or structs."""
    kind = df.schema[record].dataType
    if isinstance(kind, T.StructType):
        known = set(kind.names)
        told = F.array(*[F.lit(p) for p in typed_paths(kind)])
        read = df.withColumn("fingerprint", F.when(F.col(record).isNotNull(), fingerprint(told)))
        field = lambda name: F.col(record)[name].cast("string")
        item = lambda m, name: m[name].cast("string")
        lists = {name: F.col(record)[name] for name in kind.names if isinstance(kind[name].dataType, T.ArrayType)}
        fit = [x for x in layouts if any(sorted(set(shape)) == sorted(set(typed_paths(kind))) for shape in x.shapes())]
    else:
        known = None
        top, arrays, paths = _json_record(F.col(record), layouts)
        read = df.withColumn("_cf_top", top)
        for name, found in arrays.items():
            read = read.withColumn(f"_cf_{name}", found)
        read = read.withColumn("fingerprint", F.when(F.col("_cf_top").isNotNull(), fingerprint(paths)))
        field = lambda name: F.try_element_at("_cf_top", F.lit(name))
        item = lambda m, name: F.try_element_at(m, F.lit(name))
        lists, fit = {name: F.col(f"_cf_{name}") for name in arrays}, layouts
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for layout in fit:
        fits = _fits(layout)
        name, turns = F.when(fits, F.lit(layout.name)).otherwise(name), F.when(fits, _turns(layout, field, item, lists, known)).otherwise(turns)
    own = [c for c in read.columns if c.startswith("_cf_")]
    return read.withColumn("layout", name).withColumn("turns", turns).drop(*own)


def _fits(layout: Layout) -> Column:
    fits = F.lit(False)
    for shape in layout.shapes():
        fits = fits | (F.col("fingerprint") == fingerprint(F.array(*[F.lit(p) for p in shape])))
    return fits


def _said(role: Column, text: Column, layout: Layout) -> Column:
    named = F.coalesce(role, F.lit(""))
    for old, new in layout.aliases.items():
        named = F.when(role == old, F.lit(new)).otherwise(named)
    return F.struct(named.alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _turns(layout: Layout, field, item, lists: dict[str, Column], known: set[str] | None) -> Column:
    if layout.array:
        turn = lambda m: _said(item(m, layout.role), item(m, layout.text), layout)
        return F.coalesce(F.transform(lists[layout.array], turn), F.array().cast(TURNS))
    if not layout.turns:
        return F.array(_said(field(layout.role), field(layout.text), layout)).cast(TURNS)

    def said(role: str, names: tuple[str, ...]) -> Column:
        texts = [field(name) for name in names if known is None or name in known]
        whole = F.array_join(F.filter(F.array(*texts).cast("array<string>"), lambda x: x.isNotNull() & (x != "")), "\n\n")
        needed = [name for name in names if name not in layout.optional]
        turn = F.struct(F.lit(role).alias("role"), whole.alias("text"))
        return F.when(F.lit(bool(needed)) | (whole != ""), turn)

    return F.filter(F.array(*[said(*t) for t in layout.turns]), lambda t: t.isNotNull()).cast(TURNS)


def escape(text: Column) -> Column:
    r"""Doubles backslashes and breaks up ``<|``, so no mark of the template can occur."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    """Takes back ``escape`` and ``escape_role``."""
    pieces = F.split(text, r"\\\\")
    plain = F.transform(pieces, lambda p: F.replace(F.replace(p, F.lit("\\|"), F.lit("|")), F.lit("\\n"), F.lit("\n")))
    return F.array_join(plain, "\\")


def _head(role: Column) -> Column:
    return F.concat(F.lit(START), escape_role(F.coalesce(role, F.lit(""))), F.lit("\n"))


def _let(value: Column, use) -> Column:
    """``use`` of the value, which is computed once; inside a lambda of another column it would be for every element."""
    return F.transform(F.array(value), use)[0]


END_MARK = r"<\|im_end\|>\n"
SPANS = "array<struct<start:bigint,length:bigint,turn:int,at:bigint>>"


def format_chats(df: DataFrame, turns: str = "turns", learn_role: str = "assistant") -> DataFrame:
    """Adds ``formatted`` and ``loss_spans`` to records with an array of turns.

    A span is what is trained on: start and length in code points, the number of its turn (from 0), and where it starts
    in that turn's piece. It covers an assistant turn's escaped text alone: neither the marks nor the role.
    """
    pieces = F.transform(
        F.col(turns),
        lambda t: F.struct(_head(t["role"]).alias("head"), escape(F.coalesce(t["text"], F.lit(""))).alias("body"), F.coalesce(t["role"] == learn_role, F.lit(False)).alias("learn")),
    )

    def span(sizes: Column, p: Column, k: Column) -> Column:
        before = F.aggregate(F.slice(sizes, F.lit(1), k), F.lit(0).cast("long"), lambda s, n: s + n)
        at = F.length(p["head"]).cast("long")
        return F.when(p["learn"], F.struct((before + at).alias("start"), F.length(p["body"]).cast("long").alias("length"), k.alias("turn"), at.alias("at")))

    def spans(made: Column) -> Column:
        sizes = F.transform(made, lambda p: (F.length(p["head"]) + F.length(p["body"]) + len(END)).cast("long"))
        return _let(sizes, lambda each: F.filter(F.transform(made, lambda p, k: span(each, p, k)), lambda s: s.isNotNull()).cast(SPANS))

    return (
        df.withColumn("_cf_pieces", pieces)
        .withColumn("formatted", F.array_join(F.transform("_cf_pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), ""))
        .withColumn("loss_spans", _let(F.col("_cf_pieces"), spans))
        .drop("_cf_pieces")
    )


def format_rows(rows: DataFrame, learn_role: str = "assistant", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(conv_id, formatted, loss_spans) of (conv_id, turn, role, text) rows, as ``format_chats`` gives them.

    Every row is a record of its own, which its layout makes a turn of.
    """
    said = canonical_turns(rows.select("conv_id", "turn", F.struct("role", "text").alias("record")), layouts=layouts)
    order = Window.partitionBy("conv_id").orderBy("turn", "record.role", "record.text")
    turn, head = F.col("turns")[0], F.col("_cf_head")
    told = said.withColumn("_cf_head", _head(turn["role"])).withColumn("_cf_body", F.length(escape(turn["text"])).cast("long"))
    told = told.withColumn("_cf_size", F.length(head) + F.col("_cf_body") + len(END))
    told = told.withColumn("_cf_n", F.row_number().over(order) - 1).withColumn("_cf_start", F.sum("_cf_size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_cf_size"))
    at = F.length(head).cast("long")
    span = F.struct((F.col("_cf_start") + at).alias("start"), F.col("_cf_body").alias("length"), F.col("_cf_n").alias("turn"), at.alias("at"))
    piece = F.concat(head, escape(turn["text"]), F.lit(END))
    met = told.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("_cf_n").alias("n"), piece.alias("piece")))).alias("pieces"),
        F.array_sort(F.collect_list(F.when(turn["role"] == learn_role, span))).cast(SPANS).alias("loss_spans"),
    )
    return met.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"), "loss_spans")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text, unescaped."""
    parts = F.filter(F.split(formatted, END_MARK), lambda p: p != "")

    def turn(p: Column) -> Column:
        inner = F.substring(p, len(START) + 1, 2147483647)
        role = F.substring_index(inner, "\n", 1)
        text = inner.substr(F.length(role) + 2, F.length(inner))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, turn)


def masked_text(formatted: Column, spans: Column) -> Column:
    """What lies under the loss mask, unescaped, with nothing between the spans."""
    cut = lambda pieces, s: F.get(pieces, s["turn"]).substr((s["at"] + 1).cast("int"), s["length"].cast("int"))
    return _let(F.split(formatted, END_MARK), lambda pieces: F.array_join(F.transform(spans, lambda s: unescape(cut(pieces, s))), ""))
