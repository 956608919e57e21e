"""Facts of Solidity sources as relations: pieces, blocks, functions, modifiers, loops, calls, assignments.

A source is cut into pieces that end at a brace or a semicolon. Depths are running counts over a file's pieces and a block is
an opening piece with the next closing one of its level, so that windows over one file do what a parser's stack would do.
All relations have file, contract and line (from 1 on).
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..sources.tables import written

#: Words of a function's header that are no modifiers.
KEYWORDS = ("public", "external", "internal", "private", "view", "pure", "payable", "virtual", "override", "returns", "constant", "memory", "calldata", "storage")
#: What a modifier's name contains, in lower case, if it restricts access.
ACCESS = ("only", "auth", "admin", "owner", "require")
SPACE = " \t\n\x0b\f\r"  # what \s stands for
#: What in a block checks the calls in it.
CHECKS = r"require\(|assert\(|\nif "
METHOD = r"\.(?:call|delegatecall|staticcall|transfer|send)"  # told faster than CALL
CALL = r"((?:[\w$]+(?:\([^()]*\)|\[[^\[\]]*\])*\.)*[\w$]+(?:\([^()]*\)|\[[^\[\]]*\])*)\.(call|delegatecall|staticcall|transferFrom|transfer|send)\s*(?:\{[^{}]*\})?\s*(\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))"


def without_comments(text: Column) -> Column:
    """Comments go, their newlines stay; so lines keep their numbers."""
    inner = F.transform(F.split(text, r"/\*"), lambda x, i: F.when(i == 0, x).when(F.locate("*/", x) > 0, F.concat(F.regexp_replace(F.substring_index(x, "*/", 1), r"[^\n]", ""), F.substr(x, F.locate("*/", x) + 2))).otherwise(F.regexp_replace(x, r"[^\n]", "")))
    return F.regexp_replace(F.array_join(inner, ""), r"(\"(?:[^\"\\\n]|\\.)*\")|//[^\n]*", "$1")


def grouped(text: Column) -> Column:
    """struct(outer, inner) of a text by its parentheses of the outermost level: what stands before, between and after them, and
    what each pair holds, whatever the depth of pairs within. An open pair ends with the text."""
    add = lambda xs, p: F.concat(F.slice(xs, F.lit(1), F.size(xs) - 1), F.array(F.concat(F.element_at(xs, -1), p)))
    new = lambda xs, p: F.concat(xs, F.array(F.substring(p, 2, 2**31 - 1)))

    def step(acc: Column, p: Column) -> Column:
        d, outer, inner = acc["d"], acc["outer"], acc["inner"]
        opens, closes = p.startswith("("), p.startswith(")")
        return F.struct(
            (d + F.when(opens, 1).when(closes & (d > 0), -1).otherwise(0)).alias("d"),
            F.when(d > F.when(closes, 1).otherwise(0), outer).when(opens, outer).when(closes & (d == 1), new(outer, p)).otherwise(add(outer, p)).alias("outer"),
            F.when(opens & (d == 0), new(inner, p)).when(opens | (closes & (d > 1)), add(inner, p)).otherwise(inner).alias("inner"),
        )

    start = F.struct(F.lit(0).alias("d"), F.array(F.lit("")).alias("outer"), F.array().cast("array<string>").alias("inner"))
    return F.aggregate(F.split(text, r"(?=[()])"), start, step, lambda acc: F.struct(acc["outer"].alias("outer"), acc["inner"].alias("inner")))


def _joined(g: Column, k: Column) -> Column:
    """The text of grouped() after its k-th pair, counted from 0."""
    tail = F.zip_with(F.slice(g["inner"], k + 2, F.size(g["inner"])), F.slice(g["outer"], k + 3, F.size(g["outer"])), lambda i, o: F.concat(F.lit("("), i, F.lit(")"), F.coalesce(o, F.lit(""))))
    return F.concat(F.coalesce(F.get(g["outer"], k + 1), F.lit("")), F.array_join(tail, ""))


#: What a member of a contract is by its header; a statement that runs over and over, with what may stand before it.
FUNCTION = r"^(function\b|constructor\s*\(|fallback\s*\(|receive\s*\()"
CONTRACT = r"(?:^|\s)(contract|library|interface)\s+([\w$]+)(?:\s+is\b[^{]*)?$"
LOOP = r"^((?:else\b\s*|if\s*\(\)\s*)*)(for|while)\s*\(\)"


def pieces(sources: DataFrame) -> DataFrame:
    """The parts of a source up to each brace or semicolon, and where they stand: (file, pos, raw, piece, line, step, before,
    after, end, end_line, header, contract, kind, c_pos, c_end, m_pos, m_end, checked).

    step: whether a block opens (1) or closes (-1); before, after: depths; of an opening piece, end and end_line: where its
    block closes, header: what opens it. contract and kind, c_pos and c_end: the block of the outermost level around it; m_pos
    and m_end: the block of the next one, which is a function or another member. All of these are running counts and last
    values over one file's pieces; whole sources are dealt by file, once, before they are cut. checked: whether the first pragma's arithmetic is.
    """
    text = without_comments(F.coalesce("content", F.lit("")))
    text = F.regexp_replace(text, r"(?m)[{};](?=[^\"\n]*\"(?:[^\"\n]*\"[^\"\n]*\")*[^\"\n]*$)", " ")
    text = F.regexp_replace(text, r"\bfor\s*\(([^;{}]*);([^;{}]*);", "for ($1\x01$2\x01")  # the semicolons of a for don't end a piece,
    text = F.regexp_replace(F.regexp_replace(text, r"\{(\s*(?:value|gas|salt)\s*:[^{};]*)\}", "\x02$1\x03"), r"\(\{([^{};]*)\}\)", "(\x02$1\x03)")  # nor options and fields of a call
    checked = F.coalesce(rules.version(F.col("content")) >= F.struct(F.lit(0), F.lit(8), F.lit(0)), F.lit(False))
    n = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a fixed number: few bytes are much work here
    cut = sources.repartition(n, "file").select("file", checked.alias("checked"), F.split(text, r"(?<=[{};])").alias("cut"))  # once a file: what stands beside a generator is worked out for each row
    cut = cut.select("file", "checked", F.posexplode_outer("cut").alias("pos", "raw"))  # of a plain one Spark infers a filter, which would cut each text twice
    raw = F.col("raw")
    cut = cut.withColumn("raw", F.when(raw.contains("\x01") | raw.contains("\x02") | raw.contains("\x03"), F.translate("raw", "\x01\x02\x03", ";{}")).otherwise(raw))
    order = Window.partitionBy("file").orderBy("pos")
    newlines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    end = F.substring(F.rtrim("raw"), -1, 1)
    step = F.when(end == "{", 1).when(end == "}", -1).otherwise(0)
    out = cut.withColumns({"piece": F.btrim("raw", F.lit(SPACE)), "step": step})
    before = lambda c: F.coalesce(F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = out.withColumns({"before": before("step"), "line": 1 + before(newlines(F.col("raw"))) + newlines(F.col("raw")) - newlines(F.ltrim("raw", F.lit(SPACE)))})
    out = out.withColumn("after", F.col("before") + F.col("step"))
    # from the last piece on, the closing piece of a level seen last is the next one of an opening piece
    level = F.when(F.col("step") == 1, F.col("before")).otherwise(F.col("after"))
    back = Window.partitionBy("file", "level").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    closing = F.last(F.when(F.col("step") == -1, F.struct(F.col("pos").alias("end"), (F.col("line") + newlines(F.col("piece"))).alias("end_line"))), ignorenulls=True).over(back)
    opens = F.col("step") == 1
    out = out.withColumn("level", level).withColumn("closing", closing)
    out = out.withColumns({"end": F.when(opens, F.coalesce("closing.end", F.lit(2**31 - 1))), "end_line": F.when(opens, F.coalesce("closing.end_line", "line")), "header": F.when(opens, F.rtrim(F.substr("piece", F.lit(1), F.length("piece") - 1), F.lit(SPACE)))}).drop("closing", "level")
    around = order.rowsBetween(Window.unboundedPreceding, 0)
    top = F.when(opens & F.col("header").rlike(CONTRACT), F.struct(F.regexp_extract("header", CONTRACT, 2).alias("contract"), F.regexp_extract("header", CONTRACT, 1).alias("kind"), F.col("pos").alias("c_pos"), F.col("end").alias("c_end")))
    member = F.when(opens & (F.col("before") == 1), F.struct(F.col("pos").alias("m_pos"), F.col("end").alias("m_end")))
    out = out.withColumns({"c": F.last(top, ignorenulls=True).over(around), "m": F.last(member, ignorenulls=True).over(around)})
    inside = lambda of, at, names: {x: F.when(F.col("pos") <= F.col(f"{of}.{at}"), F.col(f"{of}.{x}")) for x in names}
    return out.withColumns(inside("c", "c_end", ("contract", "kind", "c_pos", "c_end")) | inside("m", "m_end", ("m_pos", "m_end"))).drop("c", "m")


def contracts(parts: DataFrame) -> DataFrame:
    """(file, contract, kind, pos, end)."""
    return parts.where("pos = c_pos").select("file", "contract", "kind", "pos", "end")


def members(parts: DataFrame) -> DataFrame:
    """A row for each function and modifier, with or without a body: (file, contract, checked, m_pos, header, line, end_line, base,
    all): all has its pieces after the header, in order. Grouped where pieces() put them."""
    bare = (F.col("before") == 1) & (F.col("step") == 0) & F.col("piece").rlike(r"^(function|modifier)\b")  # declared, not defined
    at = F.when(bare, F.col("pos")).otherwise(F.col("m_pos"))
    head = (F.col("pos") == at)
    held = parts.where("contract IS NOT NULL").withColumn("at", at).where("at IS NOT NULL")
    fields = F.struct("pos", "raw", "piece", "line", "before", "step", "end", "end_line")
    rows = held.groupBy("file", "contract", "at").agg(
        F.first("checked").alias("checked"), F.max(F.when(head, F.regexp_replace(F.coalesce("header", "piece"), r"\s*;$", ""))).alias("header"), F.max(F.when(head, F.col("line"))).alias("line"),
        F.max(F.when(head, F.coalesce("end_line", "line"))).alias("end_line"), F.max(F.when(head, F.coalesce("end", "pos"))).alias("end"), F.max(F.when(head, F.col("after"))).alias("base"), F.max(F.when(head, F.col("step"))).alias("defined"), F.array_sort(F.collect_list(F.when(~head, fields))).alias("all"),
    )
    return rows.withColumnRenamed("at", "m_pos").where(F.col("header").rlike(FUNCTION + r"|^modifier\b"))


def _text(pieces_: Column) -> Column:
    """The text of pieces, from the opening brace to the closing one."""
    return F.concat(F.lit("{"), F.array_join(F.transform(pieces_, lambda x: x["raw"]), ""))


def modifiers(rows: DataFrame) -> DataFrame:
    """(file, contract, name, line, body, is_access_control)."""
    named = rows.where(F.col("header").rlike(r"^modifier\s")).select("file", "contract", "line", F.regexp_extract("header", r"^modifier\s+([\w$]+)", 1).alias("name"), F.when(F.col("defined") == 1, _text(F.col("all"))).otherwise("").alias("body"))
    return named.withColumn("is_access_control", F.lower("name").rlike("|".join(ACCESS)))


def functions(rows: DataFrame) -> DataFrame:
    """(file, contract, func, pos, end, line, end_line, visibility, mutability, modifiers, params, returns, header, body, checked,
    base, all), one for each function, also of those that are declared only (an empty body). The header is read by the depth
    of its parentheses: parameters are the first pair, what follows outside of pairs are words, returns are their own pair."""
    h = F.col("header")
    held = rows.where(h.rlike(FUNCTION)).withColumn("g", grouped(h))
    outer, inner = F.col("g.outer"), F.col("g.inner")
    named = F.coalesce(F.nullif(F.regexp_extract(h, r"^function\s+([\w$]+)", 1), F.lit("")), F.nullif(F.regexp_extract(h, r"^(constructor|receive)", 1), F.lit("")), F.lit("fallback"))
    words = F.regexp_extract_all(F.array_join(F.slice(outer, F.lit(2), F.size(outer)), " ; "), F.lit(r"([A-Za-z_$][\w$.]*)"), F.lit(1))
    pick = lambda choices, other: F.coalesce(F.get(F.filter("words", lambda x: x.isin(*choices)), F.lit(0)), F.lit(other))
    at = F.array_position(F.transform(outer, lambda x: x.rlike(r"\breturns\s*$")), F.lit(True))
    back = F.when(at > 0, F.get(inner, (at - 1).cast("int"))).otherwise("")
    held = held.withColumns({"words": words, "gp": grouped(F.coalesce(F.get(inner, F.lit(0)), F.lit(""))), "gr": F.when(at > 0, grouped(back))})
    return held.select(
        "file", "contract", named.alias("func"), F.col("m_pos").alias("pos"), "end", "line", "end_line", pick(("public", "external", "internal", "private"), "internal").alias("visibility"), pick(("view", "pure", "payable"), "").alias("mutability"),
        F.filter("words", lambda x: ~x.isin(*KEYWORDS)).alias("modifiers"), declared(F.col("gp")).alias("params"), F.coalesce(declared(F.col("gr")), F.array().cast("array<struct<type_name: string, name: string>>")).alias("returns"), "header", F.when(F.col("defined") == 1, _text(F.col("all"))).otherwise("").alias("body"), "checked", "base", "all",
    )


def declared(g: Column) -> Column:
    """Array of (type_name, name) of a list of parameters as from grouped(); commas within pairs don't divide them."""
    flat = F.array_join(F.zip_with(F.transform(g["outer"], lambda x: F.replace(x, F.lit(","), F.lit("\x01"))), g["inner"], lambda o, i: F.concat(o, F.coalesce(F.concat(F.lit("("), i, F.lit(")")), F.lit("")))), "")
    name = lambda x: F.regexp_extract(x, r"[\s)]([\w$]+)\s*$", 1)
    one = lambda x: F.struct(F.regexp_extract(x, r"^\s*([\w$.]+(?:\([^()]*\))?(?:\[[^\]]*\])*|mapping\s*\(.*\))", 1).alias("type_name"), F.when(name(x).isin(*KEYWORDS), "").otherwise(name(x)).alias("name"))
    return F.transform(F.filter(F.split(flat, "\x01"), lambda x: F.trim(x) != ""), one)


def statements(funcs: DataFrame) -> DataFrame:
    """(file, contract, func, f_pos, pos, line, level, step, stmt, checked) of each piece inside a function; level 0: at the top of its body."""
    held = funcs.select("file", "contract", "func", "checked", F.col("pos").alias("f_pos"), "end", "base", F.explode("all").alias("p")).where("p.pos < end AND p.piece <> '}'")
    return held.select("file", "contract", "func", "f_pos", "p.pos", "p.line", (F.col("p.before") - F.col("base")).alias("level"), "p.step", F.col("p.piece").alias("stmt"), "checked")


def spans(funcs: DataFrame, keep: Column) -> DataFrame:
    """(file, contract, func, f_pos, pos, end, line, end_line, header, body) of the blocks within functions whose header (a column of
    that name) keep accepts."""
    opened = funcs.select("file", "contract", "func", F.col("pos").alias("f_pos"), "all", F.explode_outer(F.filter("all", lambda p: p["step"] == 1)).alias("p"))
    held = opened.withColumn("header", F.regexp_replace("p.piece", r"\s*\{$", "")).where(keep)
    body = _text(F.filter("all", lambda x: (x["pos"] > F.col("p.pos")) & (x["pos"] <= F.col("p.end"))))
    return held.select("file", "contract", "func", "f_pos", "p.pos", "p.end", "p.line", "p.end_line", "header", body.alias("body"))


def spans_of(funcs: DataFrame, pattern: str) -> DataFrame:
    return spans(funcs, F.col("header").rlike(pattern))


def within(stmts: DataFrame, spans_: DataFrame) -> DataFrame:
    """Statements inside a span of the same function, with s_pos and s_line of the innermost such span. A function's spans come to
    its statements as one array."""
    key = ["file", "contract", "func", "f_pos"]
    s = spans_.groupBy(*key).agg(F.collect_list(F.struct(F.col("pos").alias("s_pos"), F.col("line").alias("s_line"), F.col("end").alias("s_end"))).alias("spans"))
    held = stmts.join(s, key)
    inner = F.array_max(F.filter("spans", lambda x: ((F.col("pos") > x["s_pos"]) & (F.col("pos") < x["s_end"])) | ((F.col("pos") == x["s_pos"]) & (x["s_end"] == x["s_pos"]))))  # or it is the span, without braces
    return held.withColumn("s", inner).where("s IS NOT NULL").select(*stmts.columns, "s.s_pos", "s.s_line")


def calls(funcs: DataFrame) -> DataFrame:
    """(file, contract, func, pos, line, call_type, target, text, is_checked): calls of an address or a token, by method and arguments.

    A call is checked by what its statement says, or by a requirement anywhere in the innermost block around it, which is as
    far as four levels of syntax reach: expression, its statement in two, block. Blocks further out don't count.
    """
    opened = funcs.select("file", "contract", "func", F.col("pos").alias("f_pos"), F.col("end").alias("f_end"), "all", F.explode_outer(F.filter("all", lambda p: p["piece"].rlike(METHOD) & p["piece"].rlike(CALL))).alias("p")).where("p.pos < f_end")
    block = F.try_element_at(F.filter("all", lambda x: (x["step"] == 1) & (x["pos"] < F.col("p.pos")) & (x["end"] > F.col("p.pos"))), F.lit(-1))  # pieces are in order: the last one is the innermost
    held = opened.withColumn("block", block)
    since, until = F.coalesce("block.pos", "f_pos"), F.coalesce("block.end", "f_end")
    held = held.withColumns({"since": since, "until": until})
    around = F.exists("all", lambda x: (x["pos"] > F.col("since")) & (x["pos"] <= F.col("until")) & x["raw"].rlike(CHECKS))
    hits = held.select("file", "contract", "func", "p.pos", "p.line", F.col("p.piece").alias("stmt"), around.alias("around")).withColumn("text", F.explode(F.regexp_extract_all("stmt", F.lit(CALL), F.lit(0))))
    method, args = F.regexp_extract("text", CALL, 2), F.regexp_extract("text", CALL, 3)
    top = F.regexp_replace(F.regexp_replace(F.substring(args, 2, F.length(args) - 2), r"\([^()]*\)", ""), r"\([^()]*\)", "")
    n = F.when(F.trim(top) == "", 0).otherwise(F.size(F.split(top, ",")))
    kind = F.when(method == "transferFrom", "ERC20TransferFrom").when((method == "transfer") & (n == 2), "ERC20Transfer").when(method == "call", "Call").when(method == "delegatecall", "DelegateCall").when(method == "staticcall", "StaticCall").when(method == "send", "Send").otherwise("Transfer")
    checked = F.col("stmt").rlike(r"\bbool\b|success|require\(|assert\(|\bif\b") | F.col("around")
    return hits.select("file", "contract", "func", "pos", "line", kind.alias("call_type"), F.regexp_extract("text", CALL, 1).alias("target"), "text", checked.alias("is_checked"))


def assignments(stmts: DataFrame) -> DataFrame:
    """(file, contract, func, pos, line, left_side, right_side) of plain assignments to a name, a member or an element."""
    pattern = r"^(?:if\s*\(.*\)\s*|else\s+)?([\w$]+(?:\.[\w$]+|\[[^\]]*\])*)\s*=(?![=>])\s*([^;]*);?$"
    return stmts.where(F.col("stmt").rlike(pattern)).select("file", "contract", "func", "pos", "line", F.regexp_extract("stmt", pattern, 1).alias("left_side"), F.trim(F.regexp_extract("stmt", pattern, 2)).alias("right_side"))


def loops(funcs: DataFrame) -> DataFrame:
    """(file, contract, func, f_pos, pos, end, line, end_line, loop_type, condition, body, contains_external_calls,
    contains_storage_writes, iterates_over_length, checked, f_header); nested loops are rows of their own.

    A loop may stand after conditions (`else if (x) for (...)`), and its body may be a statement without braces: it is then
    the rest of the piece, or that and the block that the piece opens.
    """
    opened = funcs.select("file", "contract", "func", F.col("pos").alias("f_pos"), "checked", F.col("header").alias("f_header"), "all", F.explode("all").alias("p"))
    maybe = opened.where(F.col("p.piece").rlike(r"^(?:(?:else|if)\b.*)?\b(?:for|while)\s*\((?s:.*)|^do\b"))
    g = F.when(F.col("p.piece").rlike(r"^do\b"), F.lit(None)).otherwise(grouped(F.col("p.piece")))
    held = maybe.withColumn("g", g).withColumn("skeleton", F.array_join("g.outer", "()"))
    ends_do = F.col("skeleton").rlike(r"^while\s*\(\)\s*;$") & F.exists("all", lambda x: (F.coalesce(x["end"], x["pos"]) == F.col("p.pos") - 1) & x["piece"].rlike(r"^do\b"))
    held = held.withColumn("is_do", F.col("g").isNull()).where(F.col("is_do") | (F.col("skeleton").rlike(LOOP) & ~F.coalesce(ends_do, F.lit(False))))
    prefix, word = F.regexp_extract("skeleton", LOOP, 1), F.regexp_extract("skeleton", LOOP, 2)
    k = F.length(prefix) - F.length(F.replace(prefix, F.lit("("), F.lit("")))
    held = held.withColumns({"word": F.when(F.col("is_do"), "do").otherwise(word), "k": k.cast("int")})
    head, rest = F.get("g.inner", F.col("k")), _joined(F.col("g"), F.col("k"))
    tail = F.get(F.filter("all", lambda x: x["pos"] == F.coalesce(F.col("p.end"), F.col("p.pos")) + 1), F.lit(0))["piece"]
    kind = F.when(F.col("word") == "do", "DoWhile").when(F.col("word") == "for", "For").otherwise("While")
    condition = F.when(kind == "For", F.trim(F.get(F.split(head, ";"), F.lit(1)))).when(kind == "While", head).otherwise(F.coalesce(F.regexp_extract(tail, r"^while\s*\((.*)\)\s*;$", 1), F.lit("")))
    braced = F.col("p.step") == 1
    block = F.array_join(F.transform(F.filter("all", lambda x: (x["pos"] > F.col("p.pos")) & (x["pos"] <= F.col("p.end"))), lambda x: x["raw"]), "")
    lead = F.when(F.col("is_do"), F.regexp_replace(F.col("p.piece"), r"^do\s*", "")).otherwise(F.regexp_replace(rest, r"^\s+", ""))
    body = F.when(braced, F.concat(lead, block)).otherwise(F.concat(F.lit("{ "), lead, F.lit(" }")))
    held = held.withColumns({"kind": kind, "condition": condition, "body": body})
    writes = F.size(F.regexp_extract_all("body", F.lit(r"(?:^|[;{})])\s*[\w$]+(?:\.[\w$]+|\[[^\]]*\])*\s*(?:[+\-*/%]?=)(?![=>])"), F.lit(0)))
    return held.select(
        "file", "contract", "func", "f_pos", "p.pos", F.coalesce("p.end", "p.pos").alias("end"), "p.line", F.coalesce("p.end_line", "p.line").alias("end_line"), F.col("kind").alias("loop_type"), "condition", "body",
        F.col("body").rlike(r"\.(call|delegatecall|staticcall|transfer|send)\b\s*[({]").alias("contains_external_calls"), (writes > 2).alias("contains_storage_writes"), (F.col("condition").contains(".length") | F.col("body").contains(".length")).alias("iterates_over_length"), "checked", "f_header",
    )


class Facts:
    """All relations of sources (file, content): members() is worked out by one exchange, and the others are read off its rows.
    keep: which of members, functions and loops are tables of their own, written at their first use; for what reads them more
    than once, as a plan works out each use of a relation anew."""

    def __init__(self, sources: DataFrame, keep: Iterable[str] = ()):
        self.sources = sources.select("file", "content")
        self.keep = frozenset(keep)
        self.parts = pieces(self.sources)

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        return written(df, name) if name in self.keep else df

    @cached_property
    def members(self) -> DataFrame:
        return self._kept(members(self.parts), "members")

    @cached_property
    def functions(self) -> DataFrame:
        return self._kept(functions(self.members), "functions")

    @cached_property
    def loops(self) -> DataFrame:
        return self._kept(loops(self.functions), "loops")

    @cached_property
    def statements(self) -> DataFrame:
        return statements(self.functions)

    @cached_property
    def modifiers(self) -> DataFrame:
        return modifiers(self.members)

    @cached_property
    def calls(self) -> DataFrame:
        return calls(self.functions)

    @cached_property
    def assignments(self) -> DataFrame:
        return assignments(self.statements)

    def functions_with_modifier(self, name: str) -> DataFrame:
        return self.functions.where(F.array_contains("modifiers", name))

    def loops_with_external_calls(self) -> DataFrame:
        return self.loops.where("contains_external_calls")

    def unchecked_calls(self) -> DataFrame:
        return self.calls.where("NOT is_checked")

    def loops_before_assignments(self) -> DataFrame:
        """Loops after whose last line the same function assigns."""
        a = self.assignments.select("file", "contract", "func", F.col("line").alias("a_line"))
        key = ["file", "contract", "func"]
        last = a.groupBy(*key).agg(F.max("a_line").alias("a_line"))  # any later one is as good as the last
        return self.loops.join(last, key).where("a_line > end_line").drop("a_line")

    def access_modifiers(self) -> DataFrame:
        """(file, contract, func, modifiers): the modifiers of each function that restrict access."""
        used = self.functions.select("file", "contract", "func", F.explode("modifiers").alias("name"))
        known = self.modifiers.where("is_access_control").select("file", "contract", "name").distinct()
        return used.join(known, ["file", "contract", "name"]).groupBy("file", "contract", "func").agg(F.array_sort(F.collect_set("name")).alias("modifiers"))
