"""Analyses of SQL text on its tokens: what stands in strings and comments does not count.

The text is cut by one regular expression, so it costs one pass. ``token_table`` has a row per
statement with its tokens as an array; ``features`` walks once over those tokens that can matter, with
the depth in parentheses, the word before the innermost open parenthesis and the clause in hand, and
counts the rest with array functions. There is one shuffle, by statement, of the texts; no row per
token is made, sorted or moved. Memory is that of the largest statement. A statement's cost grows with
its tokens.

Strings in quotes or ``$$`` and comments may be open at the end of the text. A doubled quote is
part of its string; a backslash is an ordinary character. Comments do not nest. Null and empty
texts have no tokens, and a row of zeros in ``features``. Keys identify statements: they must be
unique, but a null key is a key like any other. Rows of one key become one statement, whose tokens
are taken from the rows in turn.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.session import shuffle_partitions

LETTER = r"[^\x00-\x40\x5B-\x5E\x60\x7B-\x7F]"
# Possessive loops keep Java's matcher from recursing once per round.
TOKEN = "|".join(
    (
        r"--[^\n]*+",
        r"/\*(?s:.*?)(?:\*/|\z)",
        r"'[^']*+(?:''[^']*+)*+'?",
        r"\$\$(?s:.*?)(?:\$\$|\z)",
        r'"[^"]*+(?:""[^"]*+)*+"?',
        r"`[^`]*+`?",
        rf"{LETTER}(?:{LETTER}|[0-9$#])*+",
        r"[0-9]++(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?",
        r"::|<=|>=|<>|!=|\|\|",
        r"[^\x00-\x20\x7F]",
    )
)
COMMENT = r"^(?:--|/\*)"  # as the SQL of the plans says it

# --- fixed values ------------------------------------------------------------------

CLAUSES = (
    "select", "from", "join", "on", "using", "where", "group", "having", "window", "qualify", "order",
    "limit", "offset", "fetch", "union", "intersect", "except", "minus", "set", "values", "into",
)
FROM_CLAUSES = ("from", "join", "on", "using")
NOT_A_CTE = ("time", "ordinality", "ties", "check", "local", "cascaded", "no", "data", "(")
# functions whose arguments are parted by FROM
FROM_FUNCTIONS = ("extract", "trim", "substring", "overlay")
AGGREGATES = ("count", "sum", "avg", "min", "max", "string_agg", "array_agg")
TENANT_WORD = r"^\w+_db_\w+_\d+_\w+"

# --- tokens ------------------------------------------------------------------------

AHEAD = 7  # tokens looked at behind a FROM: an optional word, three dotted names, a parenthesis


def raw_tokens(text: str | Column) -> Column:
    """Array of all tokens as they are written, strings and comments whole."""
    body = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(TOKEN), F.lit(0))


def is_open(token: Column) -> Column:
    """Whether a string or block comment lacks its end."""
    quotes = F.length(token) - F.length(F.replace(token, F.lit("'"), F.lit("")))
    return (
        (F.startswith(token, F.lit("'")) & (quotes % 2 != 0))
        | (F.startswith(token, F.lit("$$")) & ((F.length(token) < 4) | ~F.endswith(token, F.lit("$$"))))
        | (F.startswith(token, F.lit("/*")) & ((F.length(token) < 4) | ~F.endswith(token, F.lit("*/"))))
    )


def _short(token: Column) -> Column:
    """Words in lower case, quoted names behind one double quote, strings as ``'``, the rest as it is."""
    first = F.substring(token, 1, 1)
    return (
        F.when((first == "'") | F.startswith(token, F.lit("$$")), F.lit("'"))
        .when(first == '"', F.concat(F.lit('"'), F.replace(F.regexp_replace(token, r'^"|"\z', ""), F.lit('""'), F.lit('"'))))
        .when(first == "`", F.concat(F.lit('"'), F.replace(token, F.lit("`"), F.lit(""))))
        .otherwise(F.lower(token))
    )


def is_name(token: Column) -> Column:
    return token.rlike(f'^(?:"|{LETTER})')


def _true(cond: Column) -> Column:
    """A condition with null read as false."""
    return F.coalesce(cond, F.lit(False))


def token_table(statements: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_comments, open_string, tokens): the tokens of every statement but comments, in order.

    Words are in lower case, quoted names behind one double quote, strings are ``'``.
    """
    whole = statements.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # by a number, since adaptive execution would merge partitions by the bytes of texts, not by the work on them
    whole = whole.repartition(shuffle_partitions(statements.sparkSession), "key")
    in_key = Window.partitionBy("key").orderBy("text")
    every = in_key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    texts = whole.select("key", F.collect_list("text").over(every).alias("texts"), F.row_number().over(in_key).alias("place"))
    cut = texts.where(F.col("place") == 1).select("key", F.transform("texts", raw_tokens).alias("raws"))
    is_comment = lambda t: F.startswith(t, F.lit("--")) | F.startswith(t, F.lit("/*"))
    # in one expression with what reads them, these would be computed again for every token
    whole = cut.select(
        "key",
        F.array_max(F.transform("raws", lambda r: F.size(F.filter(r, is_comment)))).cast("bigint").alias("n_comments"),
        F.exists("raws", lambda r: F.exists(r, is_open)).alias("open_string"),
        F.transform("raws", lambda r: F.transform(F.filter(r, lambda t: ~is_comment(t)), _short)).alias("shorts"),
    )
    placed = F.transform("shorts", lambda s: F.transform(s, lambda t, i: F.struct(i.alias("pos"), t.alias("token"))))
    in_turn = F.transform(F.sort_array(F.flatten(placed)), lambda p: p["token"])
    tokens = F.when(F.size("shorts") == 1, F.get("shorts", F.lit(0))).otherwise(in_turn)
    return whole.select("key", "n_comments", "open_string", tokens.alias("tokens"))


# --- features ----------------------------------------------------------------------


WALKED = ("(", ")", ",", "with", "recursive", "as", "materialized", ";", *CLAUSES)
COUNTED = ("'", "over", "case", "top", *AGGREGATES)
BEFORE_CTE = ("with", "recursive", ",")


def _at(i: Column, k: int = 0) -> Column:
    """The token ``k`` places behind place ``i``, or null."""
    return F.get("tokens", i + k)


def _compares(i: Column) -> Column:
    """Whether the token before belongs to IS DISTINCT FROM."""
    return _true((_at(i, -1) == "distinct") & _at(i, -2).isin("is", "not"))


def _plain(name: Column) -> Column:
    return F.when(F.startswith(name, F.lit('"')), F.substring(name, F.lit(2), F.length(name))).otherwise(name)


def _table_at(i: Column) -> Column:
    """The schema and table, packed, whose names begin at a place, or null."""
    at = [_at(i, k) for k in range(AHEAD - 1)]
    second = _true((at[1] == ".") & is_name(at[2]))
    third = second & _true((at[3] == ".") & is_name(at[4]))
    packed = (
        F.when(third, F.when(_behind(at[5]), _packed(_plain(at[2]), _plain(at[4]))))
        .when(second, F.when(_behind(at[3]), _packed(_plain(at[0]), _plain(at[2]))))
        .when(_behind(at[1]), _packed(F.lit(None).cast("string"), _plain(at[0])))
    )
    return F.when(is_name(at[0]), packed)


def _behind(token: Column) -> Column:
    """Whether what stands behind a name does not make it a function."""
    return F.coalesce(token, F.lit("")) != "("


def _packed(schema: Column, name: Column) -> Column:
    """Both names in one string, which array functions hash; structs they would compare one by one."""
    return F.concat(F.coalesce(F.length(schema), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce(schema, F.lit("")), name)


def _unpacked(packed: Column) -> Column:
    size = F.substring_index(packed, ":", 1)
    n, at = size.cast("int"), F.length(size) + 2
    schema = F.when(n >= 0, F.substring(packed, at, n))
    return F.struct(schema.alias("schema_name"), F.substring(packed, at + F.greatest(n, F.lit(0)), F.length(packed)).alias("table_name"))


# The words that hold in a parenthesis, as a number: whether its clause is a WITH or a table list, whether it
# belongs to a function with a FROM of its own, whether it holds a query. Spark copies the state of an
# aggregate over an array at every step, so it has numbers and two strings of a letter per entry, no lists.
WITH, TABLES, FUNCTION, QUERY = 1, 2, 4, 8
START = f"named_struct('depth', 0, 'highest', 0, 'lowest', 0, 'outer', '', 'marks', '{chr(65 + QUERY)}')"


def _flag(cond: Column, value: int) -> Column:
    return F.when(cond, value).otherwise(0)


def _letter(number: Column) -> Column:
    return F.char((number + 65).cast("bigint"))


def _step(state: Column, i: Column) -> Column:
    """The state of the walk behind the token at place ``i``; ``marks`` begins with the letter of what holds there."""
    token, after, outer = _at(i), _at(i, 1), state["outer"]
    opens, closes = token == "(", token == ")"
    depth = state["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
    is_with = (token == "with") & ~_true(after.isin(*NOT_A_CTE))
    starts = (token.isin(";", *CLAUSES) & ~((token == "from") & _compares(i))) | is_with
    now = F.ascii(state["marks"]) - 65
    # an ORDER BY of a window or an aggregate stands in a parenthesis that holds no query
    opened = _flag(_at(i, -1).isin(*FROM_FUNCTIONS), FUNCTION) + _flag(after.isin("select", "with", "("), QUERY)
    clause = F.when(token == "with", WITH).when(token.isin(*FROM_CLAUSES), TABLES).otherwise(0)
    inside = (
        F.when(opens, _letter(opened))
        .when(closes, F.when(outer == "", chr(65 + QUERY)).otherwise(F.substring(outer, 1, 1)))  # the words around it hold again
        .when(starts, _letter(now.bitwiseAND(FUNCTION + QUERY) + clause))
        .otherwise(F.substring(state["marks"], 1, 1))
    )
    return F.struct(
        depth.alias("depth"),
        F.greatest(state["highest"], depth).alias("highest"),
        F.least(state["lowest"], depth).alias("lowest"),
        F.when(opens, F.concat(F.substring(state["marks"], 1, 1), outer))
        .when(closes, F.substring(outer, F.lit(2), F.length(outer)))
        .otherwise(outer)
        .alias("outer"),
        F.concat(inside, state["marks"]).alias("marks"),
    )


def features(tokens: DataFrame, key: str) -> DataFrame:
    """One row per statement: counts of constructs, its tables without those it defines, lint flags.

    A name that a WITH clause of the statement defines is no table anywhere in it. Arrays hold
    distinct names of one statement.
    """
    walked = lambda t, i: t.isin(*WALKED) | _true(_at(i, -1).isin(*BEFORE_CTE))
    places = F.transform("tokens", lambda t, i: F.when(t.isin(*WALKED, *COUNTED) | walked(t, i), i))
    placed = tokens.select("*", F.filter(places, lambda i: i.isNotNull()).alias("places"))
    steps = F.filter("places", lambda i: walked(_at(i), i))
    placed = placed.select("*", steps.alias("steps"))
    seen = placed.select("*", F.aggregate("steps", F.expr(START), _step).alias("walk"))
    walk = F.col("walk")
    seen = seen.select("*", F.split(F.reverse(walk["marks"]), "").alias("marks"))  # the first is that of the start

    def marked(cond):
        has = lambda at: lambda flag: (F.ascii(F.get("marks", at + 1)) - 65).bitwiseAND(flag) != 0
        return F.filter("steps", lambda i, at: cond(i, has(at)))

    is_cte = lambda i, has: _at(i, -1).isin(*BEFORE_CTE) & has(WITH) & (_at(i) != "recursive") & is_name(_at(i))
    is_body = lambda i, has: _at(i).isin("as", "materialized") & (_at(i, 1) == "(") & _at(i, 2).isin("select", "with") & has(WITH)
    is_order = lambda i, has: (_at(i) == "order") & (_at(i, 1) == "by") & has(QUERY)
    leads = lambda i, has: (
        ((_at(i) == "from") & ~_compares(i)) | (_at(i) == "join") | ((_at(i) == ",") & has(TABLES))
    ) & ~has(FUNCTION)
    begins = lambda i: F.when(_at(i, 1).isin("only", "lateral"), i + 2).otherwise(i + 1)
    seen = seen.select("*", marked(is_cte).alias("cte_places"), F.transform(marked(leads), begins).alias("table_places"))
    seen = seen.select("*", F.transform("table_places", _table_at).alias("found"))
    count = lambda cond: F.size(F.filter("places", lambda i: cond(i))).cast("bigint")
    any_of = lambda cond: F.exists("places", lambda i: _true(cond(i)))
    is_select = lambda i: _at(i) == "select"
    named = seen.select(
        F.col("key").alias(key),
        "n_comments",
        count(lambda i: _at(i) == "'").alias("n_strings"),
        walk["highest"].cast("bigint").alias("max_depth"),
        F.size("cte_places").cast("bigint").alias("n_cte"),
        count(lambda i: (_at(i) == "over") & ((_at(i, 1) == "(") | ((_at(i, -1) == ")") & is_name(_at(i, 1))))).alias("n_window"),
        (count(lambda i: (_at(i) == "(") & _at(i, 1).isin("select", "with")) - F.size(marked(is_body))).alias("n_subquery"),
        count(lambda i: _at(i) == "join").alias("n_join"),
        count(lambda i: (_at(i) == "case") & (F.coalesce(_at(i, -1), F.lit("")) != "end")).alias("n_case"),
        count(lambda i: _at(i).isin(*AGGREGATES) & (_at(i, 1) == "(")).alias("n_aggregate"),
        any_of(is_select).alias("has_select"),
        any_of(lambda i: is_select(i) & ((_at(i, 1) == "*") | ((_at(i, 1) == "distinct") & (_at(i, 2) == "*")))).alias("select_star"),
        any_of(lambda i: _at(i) == "where").alias("has_where"),
        (F.size(marked(is_order)) > 0).alias("has_order"),
        any_of(lambda i: _at(i).isin("limit", "fetch") | ((_at(i) == "top") & _at(i, -1).isin("select", "distinct"))).alias("has_limit"),
        any_of(lambda i: is_select(i) & (_at(i, 1) == "distinct")).alias("distinct"),
        F.exists("tokens", lambda t: t.rlike(TENANT_WORD)).alias("multi_tenant"),
        ((walk["depth"] != 0) | (walk["lowest"] < 0)).alias("unbalanced_parentheses"),
        "open_string",
        F.array_distinct(F.transform("cte_places", lambda i: _plain(_at(i)))).alias("ctes"),
        F.array_distinct(F.filter("found", lambda t: t.isNotNull())).alias("tables"),
    )
    own = F.transform("ctes", lambda c: _packed(F.lit(None).cast("string"), c))
    return named.withColumn("tables", F.transform(F.array_except("tables", own), _unpacked))


def table_index(features: DataFrame, key: str) -> DataFrame:
    """(key, schema_name, table_name) of every table a statement reads; schema null if none is named."""
    # a plain explode lets the optimizer filter by the array's size first, with all of ``features`` copied into lambdas
    each = features.select(key, F.explode_outer("tables").alias("t")).where(F.col("t").isNotNull())
    return each.select(key, "t.schema_name", "t.table_name")


def complexity() -> Column:
    """1 for a select, 2 per join, 3 for a nested select, 2 per CASE and per window."""
    nested = F.when((F.col("n_subquery") + F.col("n_cte")) > 0, 3).otherwise(0)
    return (
        F.when(F.col("has_select"), 1).otherwise(0) + 2 * F.col("n_join") + nested + 2 * F.col("n_case") + 2 * F.col("n_window")
    ).cast("bigint")


def lint_rules() -> dict[str, Column]:
    """Rule name → whether the statement of a ``features`` row breaks it."""
    joins = F.col("n_join")
    return {
        "select_star": F.col("select_star"),
        "several_joins": joins > 3,
        "many_joins": joins > 5,
        "some_join": (joins > 0) & (joins <= 3),
        "no_where": F.col("has_select") & ~F.col("has_where"),
        "order_without_limit": F.col("has_order") & ~F.col("has_limit"),
        "distinct": F.col("distinct"),
        "multi_tenant": F.col("multi_tenant"),
        "unbalanced_parentheses": F.col("unbalanced_parentheses"),
        "open_string": F.col("open_string"),
    }


def opportunities(names: tuple[str, ...]) -> Column:
    """How many of the named rules a statement breaks."""
    rules = lint_rules()
    return reduce(Column.__add__, [rules[n].cast("bigint") for n in names])
