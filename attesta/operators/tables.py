"""Looking up table cells and calculating with them."""

from __future__ import annotations

import ast

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.operators.citations import locator
from attesta.plans.lineage import cut

# How a calculation is reported to the model.
RESULT_TITLE = "[표 계산 결과 — {}]"
LOOKUP, CALCULATION, CONCLUSION = "조회: ", "계산: ", "결론: "


TABLE_CELLS = 4096  # cells, and requests, of a table that meet each other as they are


def query_table(cells: DataFrame, requests: DataFrame, block: int = TABLE_CELLS) -> DataFrame:
    """(query_id, table_id, r, c, text) for all requests at once.

    ``requests``: query_id, table_id and any of row, col, row_header, col_header (null:
    not asked). A header is looked for in column 0 or row 0; one that matches nothing
    selects nothing.

    A table of at most ``block`` cells and requests is shuffled once, as one row that its
    requests meet. In larger ones a request meets only the rows or columns it asks for.
    """
    asked = requests.select("query_id", "table_id", "row", "col", "row_header", "col_header")
    own = cells.select("table_id", "r", "c", "text")
    large = cut(_above(own, block).unionByName(_above(asked, block)).distinct())
    if large.isEmpty():
        return _in_tables(own, asked)
    few = [df.join(large, "table_id", "left_anti") for df in (own, asked)]
    many = [df.join(large, "table_id", "left_semi") for df in (own, asked)]
    return _in_tables(*few).unionByName(_on_axes(*many))


def _above(rows: DataFrame, block: int) -> DataFrame:
    counts = rows.groupBy("table_id").agg(F.count(F.lit(1)).alias("__n"))
    return counts.filter(F.col("__n") > block).select("table_id")


def _in_tables(own: DataFrame, asked: DataFrame) -> DataFrame:
    tables = own.groupBy("table_id").agg(F.collect_list(F.struct("r", "c", "text")).alias("__cells"))

    def named(axis: str, other: str, header: str) -> Column:
        """Places on an axis whose header holds the text asked for."""
        hit = F.filter("__cells", lambda x: (x[other] == 0) & F.contains(x["text"], F.col(header)))
        return F.when(F.col(header).isNotNull(), F.transform(hit, lambda x: x[axis]))

    met = (asked.join(tables, "table_id").withColumn("__rows", named("r", "c", "row_header"))
           .withColumn("__cols", named("c", "r", "col_header")))
    hit = F.filter("__cells", lambda x: (
        (F.col("row").isNull() | (x["r"] == F.col("row"))) & (F.col("col").isNull() | (x["c"] == F.col("col")))
        & (F.col("row_header").isNull() | F.array_contains("__rows", x["r"]))
        & (F.col("col_header").isNull() | F.array_contains("__cols", x["c"]))))
    return (met.select("query_id", "table_id", F.inline(hit))
            .select("query_id", "table_id", "r", "c", F.coalesce("text", F.lit("")).alias("text")))


def _on_axes(own: DataFrame, asked: DataFrame) -> DataFrame:
    place = lambda axis, at: F.struct(F.lit(axis).alias("axis"), at.cast("bigint").alias("at"))
    # the rows and columns whose headers are asked for, found once
    heads = own.filter("r = 0 OR c = 0").join(asked.filter("row_header IS NOT NULL OR col_header IS NOT NULL"), "table_id")
    marks = cut(heads.select("query_id", F.explode(F.array_compact(F.array(
        F.when((F.col("c") == 0) & F.contains("text", "row_header"), place("r", F.col("r"))),
        F.when((F.col("r") == 0) & F.contains("text", "col_header"), place("c", F.col("c")))))).alias("m"))
        .select("query_id", "m.*").distinct())
    # a request meets the row or the column it asks for, and a whole table only if it asks for that
    axis = (F.when(F.expr("row IS NOT NULL OR row_header IS NOT NULL"), "r")
            .when(F.expr("col IS NOT NULL OR col_header IS NOT NULL"), "c").otherwise("t"))
    wanted = asked.withColumn("axis", axis).withColumn("at", F.expr(
        "CASE axis WHEN 'r' THEN cast(row AS bigint) WHEN 'c' THEN cast(col AS bigint) ELSE 0L END"))
    named = wanted.filter("at IS NULL").drop("at").join(marks, ["query_id", "axis"])
    spread = own.select("*", F.inline(F.array(place("r", F.col("r")), place("c", F.col("c")), place("t", F.lit(0)))))
    hit = (wanted.filter("at IS NOT NULL").unionByName(named).join(spread, ["table_id", "axis", "at"])
           .filter("col IS NULL OR c = col").drop("axis", "at"))
    rows = marks.filter("axis = 'r'").select("query_id", F.col("at").alias("r"), F.lit(True).alias("__r"))
    cols = marks.filter("axis = 'c'").select("query_id", F.col("at").alias("c"), F.lit(True).alias("__c"))
    return (hit.join(rows, ["query_id", "r"], "left").join(cols, ["query_id", "c"], "left")
            .filter((F.col("row_header").isNull() | F.col("__r")) & (F.col("col_header").isNull() | F.col("__c")))
            .select("query_id", "table_id", "r", "c", F.coalesce("text", F.lit("")).alias("text")))


def calc(expression: str, values: dict[str, Column], *, on_zero: str = "error") -> Column:
    """Arithmetic over named columns as one Column: + - * / ** and parentheses.

    Anything else is refused when the plan is built. Division by zero fails the query,
    or gives null with ``on_zero='null'``.
    """
    try:
        tree = ast.parse(expression, mode="eval").body
    except SyntaxError as exc:
        raise ValueError(f"invalid expression: {expression!r}") from exc

    def divide(a: Column, b: Column) -> Column:
        if on_zero == "null":
            return F.when(b != 0, a / b)
        return F.when(b == 0, F.raise_error(F.lit("division by zero")).cast("double")).otherwise(a / b)

    binary = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b,
              ast.Div: divide, ast.Pow: F.pow}

    def column(node: ast.AST) -> Column:
        match node:
            case ast.Constant(value=bool()):
                pass
            case ast.Constant(value=int() | float() as number):
                return F.lit(float(number))
            case ast.Name(id=name) if name in values:
                return values[name].cast("double")
            case ast.Name(id=name):
                raise ValueError(f"unknown name: {name!r}")
            case ast.BinOp(left=left, op=op, right=right) if type(op) in binary:
                return binary[type(op)](column(left), column(right))
            case ast.UnaryOp(op=ast.USub(), operand=operand):
                return -column(operand)
            case ast.UnaryOp(op=ast.UAdd(), operand=operand):
                return column(operand)
        raise ValueError(f"not allowed in an expression: {type(node).__name__}")

    return column(tree)


def table_for_chunk(chunks: DataFrame, elements: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells of the table each chunk shows, by chunk.element_id."""
    linked = chunks.filter("element_id IS NOT NULL").select("chunk_id", "element_id")
    tables = elements.filter("table_id IS NOT NULL").select(F.col("id").alias("element_id"), "table_id")
    return linked.join(tables, "element_id").join(cells, "table_id").select("chunk_id", "table_id", "r", "c", "text")


def synthesize_sources(sources: DataFrame, trace: DataFrame, conclusions: DataFrame) -> DataFrame:
    """New sources, one per table a question looked into, numbered on from its last.

    ``sources``: question_id, sid, is_table and the locator columns; ``trace``:
    question_id, ord, tool (query_table / calc), table_sid, args, result; the texts of
    args and result are already rendered. Every table lists its own lookups and all
    calculations of the question. A tool loop makes few calls, so the group is small.
    """
    touched = (trace.filter("tool = 'query_table'").select("question_id", F.col("table_sid").alias("sid")).distinct()
               .join(sources.filter("is_table"), ["question_id", "sid"]))
    look = F.concat(F.lit(LOOKUP), "args", F.lit(" → "), "result")
    calculated = F.concat(F.lit(CALCULATION), "args", F.lit(" = "), "result")
    calls = trace.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct(
        "ord", F.when(F.col("tool") == "query_table", F.col("table_sid")).alias("of"),
        F.when(F.col("tool") == "query_table", look).when(F.col("tool") == "calc", calculated).alias("line"))))
        .alias("__calls"))
    last = sources.groupBy("question_id").agg(F.max("sid").alias("__last"),
                                              F.sort_array(F.collect_set("sid")).alias("__sids"))
    seen = touched.groupBy("question_id").agg(F.sort_array(F.collect_set("sid")).alias("__touched"))
    rows = (touched.join(calls, "question_id").join(last, "question_id").join(seen, "question_id")
            .join(conclusions.select("question_id", F.col("text").alias("__end")), "question_id", "left"))
    mine = F.transform(F.filter("__calls", lambda c: c["line"].isNotNull() & (
        c["of"].isNull() | (c["of"] == F.col("sid")))), lambda c: c["line"])
    first, after = RESULT_TITLE.split("{}")
    text = F.concat_ws("\n", F.concat(F.lit(first), locator(), F.lit(after)), mine,
                       F.when(F.coalesce("__end", F.lit("")) != "", F.concat(F.lit(CONCLUSION), "__end")))
    return rows.withColumn("__text", text).select(
        "question_id", (F.col("__last") + F.array_position("__touched", F.col("sid"))).alias("sid"),
        F.col("sid").alias("origin_sid"), "chunk_id", "document_id", "filename", "heading_path", "page_from",
        "page_to", F.lit(True).alias("is_table"), F.col("__text").alias("text"))
