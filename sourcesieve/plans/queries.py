"""The engine's queries over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcesieve.operators import diagnostics as D
from sourcesieve.plans.analysis import Analysis
from sourcesieve.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SCOPE = 'scope { include "**" }\n'
LETTERS = "definitions { letter = 'a'..'z' | 'A'..'Z'  digit = '0'..'9' }\n"
WORDS = SCOPE + LETTERS + "tokens { Space = (' ' | '\\n' | '\\t' | '\\r')+ skip  Word = letter+  Number = digit+  Other = fallback skip }\n"
#: Lines of words; what follows the last line end is a tail.
LINES = SCOPE + LETTERS + "tokens { Word = letter+  Nl = '\\n'  Other = fallback skip }\n" + "syntax { node Root { lines*: Line tail?: Tail } node Line { head?: W rest*: W Nl } node Tail { words+: W } node W { Word } }\n"
#: Sentences: words up to a full stop.
SENTENCES = SCOPE + LETTERS + "tokens { Word = letter+  Dot = '.'  Other = fallback skip }\nsyntax { node Root { ( s: S | any )* } node S { first: W more*: W Dot } node W { Word } }\n"
TAGS = SCOPE + "definitions { letter = 'a'..'z' | 'A'..'Z' | '0'..'9' }\ntokens { Bang = \"<!\"  Close = \"</\"  Open = \"<\"  Void = \"/>\"  End = \">\"  Name = letter+  Other = fallback skip }\n"

DOC_PATH = "concat_ws('/', lang, source, doc_id || '.txt')"
DOCUMENTS = f"SELECT {DOC_PATH} AS path, coalesce(text, '') AS content FROM documents"


def pieces(pattern: str, source: str = DOCUMENTS) -> str:
    """WITH pieces(path, t, i, start_byte, end_byte): what a pattern that misses nothing cuts each source into."""
    return f"""WITH src AS ({source}),
cut AS (SELECT path, regexp_extract_all(content, '{pattern}') AS ts FROM src),
listed AS (SELECT path, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM cut),
pieces AS (SELECT path, t, i, sum(strlen(t)) OVER (PARTITION BY path ORDER BY i)::BIGINT AS end_byte, (sum(strlen(t)) OVER (PARTITION BY path ORDER BY i) - strlen(t))::BIGINT AS start_byte FROM listed)
"""


WORD_PIECES = pieces(r"[A-Za-z]+|[0-9]+|[ \n\t\r]+|[^A-Za-z0-9 \n\t\r]+")
LINE_PIECES = pieces(r"[A-Za-z]+|\n|[^A-Za-z\n]+")
SENTENCE_PIECES = pieces(r"[A-Za-z]+|[.]|[^A-Za-z.]+")
IS_WORD = "regexp_matches(t, '^[A-Za-z]')"
IS_NUMBER = "regexp_matches(t, '^[0-9]')"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.spread(tables.documents(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.spread(tables.pages(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def shown(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.select("path", F.col("start").alias("start_byte"), F.col("end").alias("end_byte"), "severity", "message")


def summed(rows: DataFrame, *by: str) -> DataFrame:
    """How many rows, and the sums of where they start and end: as telling as the rows, and small."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends"))


SUMS = "count(*) AS n, sum(start_byte)::BIGINT AS starts, sum(end_byte)::BIGINT AS ends"


# scope


@query(f"SELECT path FROM ({DOCUMENTS}) WHERE path LIKE 'en/%' AND NOT regexp_matches(path, '^en/src1/[^/]*$') AND NOT regexp_matches(path, '(^|/)7[^/]*$')")
def scope_include_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Analysis(WORDS.replace(SCOPE, 'scope { include "en/**" exclude "en/src1/*" exclude "**/7*" }\n'))
    return a.in_scope(docs(spark, sf_dir)).select("path")


@query(f"SELECT path FROM ({DOCUMENTS}) WHERE regexp_matches(path, '^[^/]*/src[^/]/1[^/]*[.]txt$')")
def scope_single_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Analysis(WORDS.replace(SCOPE, 'scope { include "*/src?/1*.txt" }\n'))
    return a.in_scope(docs(spark, sf_dir)).select("path")


# scanner


@query(
    pieces(r"[A-Za-z]+|[0-9]+|[ \n\t\r]+|[^A-Za-z0-9 \n\t\r]+", "SELECT item_id || '.txt' AS path, text AS content FROM benchmark")
    + f"SELECT path, (row_number() OVER (PARTITION BY path ORDER BY i) - 1)::INTEGER AS tok_idx, CASE WHEN {IS_WORD} THEN 'Word' ELSE 'Number' END AS name, t AS text, start_byte, end_byte FROM pieces WHERE {IS_WORD} OR {IS_NUMBER}"
)
def scan_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    sources = tables.from_table(rows, F.concat(F.col("item_id").cast("string"), F.lit(".txt")), "text")
    return Analysis(WORDS).tokens(sources).select("path", "tok_idx", "name", F.col("text").cast("string").alias("text"), F.col("start").alias("start_byte"), F.col("end").alias("end_byte"))


@query(WORD_PIECES + f"SELECT path, CASE WHEN {IS_WORD} THEN 'Word' ELSE 'Number' END AS name, {SUMS} FROM pieces WHERE {IS_WORD} OR {IS_NUMBER} GROUP BY ALL")
def scan_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summed(Analysis(WORDS).tokens(docs(spark, sf_dir), texts=False), "path", "name")


@query(
    WORD_PIECES
    + f"""SELECT src.path, sha256(coalesce(string_agg(CASE WHEN {IS_WORD} THEN 'Word' ELSE 'Number' END || ':' || start_byte || '-' || end_byte, ' ' ORDER BY i) FILTER ({IS_WORD} OR {IS_NUMBER}), '')) AS tokens_sha256
FROM src LEFT JOIN pieces ON src.path = pieces.path GROUP BY src.path"""
)
def scan_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = Analysis(WORDS).token_lists(docs(spark, sf_dir))
    shown_ = F.transform("tokens", lambda t: F.concat(t["name"], F.lit(":"), t["start"].cast("string"), F.lit("-"), t["end"].cast("string")))
    return lists.select("path", F.sha2(F.array_join(shown_, " "), 256).alias("tokens_sha256"))


@query(
    pieces("<!|</|<|/>|>|[A-Za-z0-9]+|[^A-Za-z0-9<>]", "SELECT 'pages/' || page_id || '.html' AS path, coalesce(html, '') AS content FROM pages").replace("[^A-Za-z0-9<>]'", "[^A-Za-z0-9<>/]+|/'")
    + f"SELECT path, CASE t WHEN '<!' THEN 'Bang' WHEN '</' THEN 'Close' WHEN '<' THEN 'Open' WHEN '/>' THEN 'Void' WHEN '>' THEN 'End' ELSE 'Name' END AS name, {SUMS} FROM pieces WHERE regexp_matches(t, '^[A-Za-z0-9<>]') OR t = '/>' GROUP BY ALL"
)
def scan_longest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summed(Analysis(TAGS).tokens(pages(spark, sf_dir), texts=False), "path", "name")


@query(WORD_PIECES + f"SELECT CASE WHEN t IN ('the', 'and') THEN 'Keyword' ELSE 'Word' END AS name, {SUMS} FROM pieces WHERE {IS_WORD} GROUP BY ALL")
def scan_keyword_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Analysis(SCOPE + LETTERS + 'tokens { Keyword = "the" | "and"  Word = letter+  Other = fallback skip }')
    return summed(a.tokens(docs(spark, sf_dir), texts=False), "name")


@query(WORD_PIECES + f"SELECT path, {SUMS} FROM pieces WHERE {IS_NUMBER} GROUP BY path")
def scan_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Analysis(SCOPE + LETTERS + "tokens { Number = digit+  Word = letter+ skip  Other = fallback skip }")
    return summed(a.tokens(docs(spark, sf_dir), texts=False), "path")


@query(WORD_PIECES + f"SELECT path, sum(strlen(t))::BIGINT AS n FROM pieces WHERE NOT {IS_WORD} AND NOT {IS_NUMBER} AND NOT regexp_matches(t, '^[ \\n\\t\\r]') GROUP BY path")
def scan_fallback_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fallback token is one byte, so characters of several bytes count as often."""
    a = Analysis(WORDS.replace("Word = letter+  Number = digit+  Other = fallback skip", "Word = letter+ skip  Number = digit+ skip  Other = fallback"))
    return a.tokens(docs(spark, sf_dir), texts=False).groupBy("path").agg(F.count("*").alias("n"))


@query(
    f"SELECT path, pos AS start_byte, pos + 1 AS end_byte, 'err' AS severity, 'No token matched at byte offset ' || pos || '.' AS message FROM (SELECT path, strlen(content) AS n, strlen(regexp_extract(content, '^(?:[A-Za-z]+|[ \\n]+|[.,])*')) AS pos FROM ({DOCUMENTS})) WHERE pos < n"
)
def scan_failure_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Analysis(SCOPE + LETTERS + "tokens { Word = letter+  Space = (' ' | '\\n')+ skip  Mark = '.' | ',' }")
    return shown(a.diagnostics(docs(spark, sf_dir)))


# token rules

COMPARED = {"eq": "==", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}


def _text_rule(operator: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        a = Analysis(WORDS + f'rules {{ rule R {{ match Word where Word.text {operator} "the" report warn at Word "found" }} }}')
        return summed(a.diagnostics(docs(spark, sf_dir)), "path", "severity", "message")

    return run


for _name, _operator in COMPARED.items():
    QUERIES[f"rule_text_{_name}"] = _text_rule(_operator)
    ORACLES[f"rule_text_{_name}"] = WORD_PIECES + f"SELECT path, 'warn' AS severity, 'found' AS message, {SUMS} FROM pieces WHERE {IS_WORD} AND t {_operator.replace('==', '=')} 'the' GROUP BY path"


@query(WORD_PIECES + f"SELECT path, start_byte, end_byte, 'info' AS severity, 'starts with thin' AS message FROM pieces WHERE {IS_WORD} AND starts_with(t, 'thin')")
def rule_starts_with(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Analysis(WORDS + 'rules { rule R { match Word where Word.text startsWith "thin" report info at Word "starts with thin" } }')
    return shown(a.diagnostics(docs(spark, sf_dir)))


@query(
    WORD_PIECES
    + "SELECT path, message, "
    + SUMS
    + " FROM ("
    + " UNION ALL ".join(f"SELECT *, 'length {o}' AS message FROM pieces WHERE {IS_WORD} AND strlen(t) {o.replace('==', '=')} 7" for o in COMPARED.values())
    + ") GROUP BY ALL"
)
def rule_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six comparisons of lengths, as rules of one document: one scan."""
    rules = " ".join(f'rule {n} {{ match Word where Word.length {o} 7 report warn at Word "length {o}" }}' for n, o in zip("ABCDEF", COMPARED.values(), strict=True))
    return summed(Analysis(WORDS + f"rules {{ {rules} }}").diagnostics(docs(spark, sf_dir)), "path", "message")


@query(WORD_PIECES + f"SELECT path, {SUMS} FROM pieces WHERE {IS_WORD} OR {IS_NUMBER} GROUP BY path")
def rule_without_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Property against property holds for every token here, as no condition does."""
    a = Analysis(WORDS + 'rules { rule A { match Word report info at Word "word" } rule B { match Number where Number.text == Number.text report info at Number "number" } }')
    return summed(a.diagnostics(docs(spark, sf_dir)), "path")


# trees

LINE_SQL = (
    LINE_PIECES
    + f""", toks AS (SELECT *, {IS_WORD} AS word, row_number() OVER (PARTITION BY path ORDER BY i) - 1 AS tok FROM pieces WHERE {IS_WORD} OR t = chr(10)),
placed AS (SELECT *, sum(CASE WHEN word THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY i) - CASE WHEN word THEN 0 ELSE 1 END AS line FROM toks),
lines AS (SELECT path, line, min(start_byte) AS start_byte, max(end_byte) AS end_byte, min(tok) AS first_tok, count(*) AS n_tok, bool_or(NOT word) AS ended, min_by(t, i) FILTER (word) AS head FROM placed GROUP BY path, line),
words AS (SELECT p.*, l.ended FROM placed p JOIN lines l USING (path, line) WHERE word)
"""
)


@query(
    LINE_SQL
    + f"""SELECT path, kind_name, {SUMS}, sum(n_tok)::BIGINT AS tokens, sum(depth)::BIGINT AS depths, sum(ordinal)::BIGINT AS ordinals FROM (
  SELECT path, 'W' AS kind_name, start_byte, end_byte, 1 AS n_tok, 2 AS depth, row_number() OVER (PARTITION BY path, line ORDER BY i) - 1 AS ordinal FROM words
  UNION ALL SELECT path, CASE WHEN ended THEN 'Line' ELSE 'Tail' END, start_byte, end_byte, n_tok, 1, line FROM lines
  UNION ALL SELECT s.path, 'Root', coalesce(min(start_byte), 0), coalesce(max(end_byte), 0), count(t.path), 0, 0 FROM src s LEFT JOIN toks t ON s.path = t.path GROUP BY s.path)
GROUP BY path, kind_name"""
)
def parse_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = Analysis(LINES).nodes(docs(spark, sf_dir))
    return nodes.groupBy("path", "kind_name").agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends"), F.sum("n_tok").alias("tokens"), F.sum("depth").alias("depths"), F.sum(F.coalesce("ordinal", F.lit(0))).alias("ordinals"))


@query(
    WORD_PIECES
    + f""", toks AS (SELECT *, {IS_WORD} AS word, lead(start_byte) OVER w AS _s, lead(end_byte) OVER w AS next_end, lead({IS_NUMBER}) OVER w AS number_next FROM pieces WHERE {IS_WORD} OR {IS_NUMBER} WINDOW w AS (PARTITION BY path ORDER BY i))
SELECT path, start_byte, next_end AS end_byte FROM toks WHERE word AND number_next"""
)
def parse_any_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a word and a number, in texts that are otherwise not modelled."""
    a = Analysis(WORDS + "syntax { node Root { ( pair: Pair | any )* } node Pair { Word Number } }")
    return a.nodes(docs(spark, sf_dir)).filter("kind_name = 'Pair'").select("path", F.col("start").alias("start_byte"), F.col("end").alias("end_byte"))


@query(
    WORD_PIECES
    + f"""SELECT s.path, 0::BIGINT AS start_byte, strlen(any_value(s.content))::BIGINT AS end_byte, 'err' AS severity, 'Source text does not match syntax root "Root".' AS message
FROM src s LEFT JOIN pieces p ON s.path = p.path GROUP BY s.path HAVING count(*) FILTER ({IS_WORD}) = 0 OR count(*) FILTER ({IS_NUMBER}) > 0"""
)
def parse_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(Analysis(WORDS + "syntax { node Root { Word+ } }").diagnostics(docs(spark, sf_dir)))


def tree_rules(rules: str, document: str = LINES) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return summed(Analysis(document + f"rules {{ {rules} }}").diagnostics(docs(spark, sf_dir)), "path", "severity", "message")

    return run


def tree_query(name: str, rules: str, sql: str, document: str = LINES, base: str = LINE_SQL) -> None:
    """sql: rows with path, start_byte, end_byte, severity and message."""
    QUERIES[name] = tree_rules(rules, document)
    ORACLES[name] = base + f"SELECT path, severity, message, {SUMS} FROM ({sql}) GROUP BY ALL"


def found(severity: str, message: str, source: str) -> str:
    return f"SELECT path, start_byte, end_byte, '{severity}' AS severity, '{message}' AS message FROM {source}"


tree_query("rule_node", 'rule R { match node W where W.text == "the" report warn at W "the" } info "line": Line', found("warn", "the", "words WHERE t = 'the'") + " UNION ALL " + found("info", "line", "lines WHERE ended"))
tree_query("rule_inside", 'rule R { match node W inside Line where W.length > 9 report info at W "long" } err "w": Tail W', found("info", "long", "words WHERE ended AND strlen(t) > 9") + " UNION ALL " + found("err", "w", "words WHERE NOT ended"))
tree_query("rule_outside", 'rule R { match node W outside Line report warn at W "tail" } err "no tail": W:not(Tail *) where W.text startsWith "an"', found("warn", "tail", "words WHERE NOT ended") + " UNION ALL " + found("err", "no tail", "words WHERE ended AND starts_with(t, 'an')"))
tree_query("rule_parent", 'info "of line": Line > W where W.length <= 3 warn "of root": Root > W', found("info", "of line", "words WHERE ended AND strlen(t) <= 3"))
tree_query(
    "rule_not_parent",
    'info "not of line": W:not(Line > *) warn "no parent": Root:not(Root > *) where Root.length > 3000',
    found("info", "not of line", "words WHERE NOT ended") + " UNION ALL SELECT path, min(start_byte), max(end_byte), 'warn', 'no parent' FROM toks GROUP BY path HAVING max(end_byte) - min(start_byte) > 3000",
)
PAIRS = "(SELECT *, lag(t) OVER w AS left_t FROM words WINDOW w AS (PARTITION BY path, line ORDER BY i))"
tree_query("rule_adjacent_text", 'warn "falls": W + W where right.text < left.text err "twice": W + W where W.text == left.text', found("warn", "falls", f"{PAIRS} WHERE t < left_t") + " UNION ALL " + found("err", "twice", f"{PAIRS} WHERE t = left_t"))
LINE_PAIRS = "(SELECT *, coalesce(head, '') AS h, lag(coalesce(head, '')) OVER w AS left_h, lag(path) OVER w AS had FROM lines WHERE ended WINDOW w AS (PARTITION BY path ORDER BY line))"
tree_query("rule_adjacent_field", 'warn "order": Line + Line where right.head.text >= left.head.text', found("warn", "order", f"{LINE_PAIRS} WHERE had IS NOT NULL AND h >= left_h"))
tree_query("rule_missing_field_default", 'info "no head": Line where Line.head.text == "" warn "length 0": Line where Line.head.length < 1', found("info", "no head", "lines WHERE ended AND head IS NULL") + " UNION ALL " + found("warn", "length 0", "lines WHERE ended AND head IS NULL"))

SENTENCE_SQL = (
    SENTENCE_PIECES
    + f""", toks AS (SELECT *, {IS_WORD} AS word FROM pieces WHERE {IS_WORD} OR t = '.'),
placed AS (SELECT *, sum(CASE WHEN word THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY i) - CASE WHEN word THEN 0 ELSE 1 END AS s FROM toks),
sentences AS (SELECT path, s, min(start_byte) AS start_byte, max(end_byte) AS end_byte, min(i) AS first_i, max(i) AS last_i, min_by(t, i) AS first_t FROM placed GROUP BY path, s HAVING bool_or(word) AND bool_or(NOT word)),
feeds AS (SELECT path, i, sum(len(t) - len(replace(t, chr(10), ''))) OVER (PARTITION BY path ORDER BY i) AS n FROM pieces),
paired AS (SELECT *, lag(last_i) OVER w AS left_last, lag(end_byte) OVER w AS left_end FROM sentences WINDOW w AS (PARTITION BY path ORDER BY s)),
gaps AS (SELECT p.*, greatest(b.n - a.n - 1, 0) AS blank, p.start_byte - p.left_end AS gap_bytes FROM paired p JOIN feeds a ON p.path = a.path AND p.left_last = a.i JOIN feeds b ON p.path = b.path AND p.first_i - 1 = b.i)
"""
)
tree_query(
    "rule_gap_blank_lines",
    'info "no blank lines": S + S where gap.blankLines == 0 warn "blank lines": S + S where gap.blankLines >= 1 err "far": S + S where gap.length > 1 info "near": S + S where gap.text == " "',
    found("info", "no blank lines", "gaps WHERE blank = 0") + " UNION ALL " + found("warn", "blank lines", "gaps WHERE blank >= 1") + " UNION ALL " + found("err", "far", "gaps WHERE gap_bytes > 1") + " UNION ALL "
    + found("info", "near", "(SELECT g.*, p.t AS between FROM gaps g JOIN pieces p ON g.path = p.path AND g.first_i - 1 = p.i WHERE g.first_i - g.left_last = 2) WHERE between = ' '"),
    SENTENCES,
    SENTENCE_SQL,
)

# reports

MIXED = LINES + 'rules { rule T { match Word where Word.text == "of" report info at Word "token" } warn "node": W where W.text == "and" err "pair": Line + Line where right.head.text == left.head.text }'
MIXED_SQL = " UNION ALL ".join(
    [
        "SELECT path, start_byte, end_byte, 'info' AS severity, 'token' AS message, 0 AS phase, tok AS clock FROM toks WHERE t = 'of'",
        "SELECT path, start_byte, end_byte, 'warn', 'node', 3, tok FROM words WHERE t = 'and'",
        f"SELECT path, start_byte, end_byte, 'err', 'pair', 4, line FROM {LINE_PAIRS} WHERE had IS NOT NULL AND h = left_h",
    ]
)


@query(LINE_SQL + f"SELECT path, start_byte, end_byte, severity, message FROM ({MIXED_SQL})")
def diagnostics_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(Analysis(MIXED).diagnostics(docs(spark, sf_dir)))


@query(LINE_SQL + f"SELECT path, start_byte, end_byte, severity, message FROM ({MIXED_SQL}) QUALIFY row_number() OVER (PARTITION BY path ORDER BY phase, clock) = 1")
def diagnostics_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(Analysis(MIXED).diagnostics(docs(spark, sf_dir), first=True))


@query(LINE_SQL + f"SELECT path, severity, message, start_byte, end_byte, row_number() OVER (ORDER BY string_split(path, '/'), phase, clock) AS place FROM ({MIXED_SQL}) WHERE phase = 0")
def diagnostics_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(Analysis(LINES.split("syntax")[0] + 'rules { rule T { match Word where Word.text == "of" report info at Word "token" } }').diagnostics(docs(spark, sf_dir)))


@query(LINE_SQL + f"SELECT path, severity, message, start_byte, end_byte, row_number() OVER (ORDER BY string_split(path, '/'), phase, clock) AS place FROM ({MIXED_SQL})")
def diagnostics_ordered_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's order over token rules, node rules and sibling pairs."""
    return placed(Analysis(MIXED).diagnostics(docs(spark, sf_dir)))


def placed(found_: DataFrame) -> DataFrame:
    """The place of each diagnostic in the report."""
    return D.numbered(found_).select("path", "severity", "message", F.col("start").alias("start_byte"), F.col("end").alias("end_byte"), "place")


@query(LINE_SQL + f"SELECT severity, count(*) AS n FROM ({MIXED_SQL}) GROUP BY severity")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.counts(Analysis(MIXED).diagnostics(docs(spark, sf_dir)))


@query(LINE_SQL + f"SELECT CASE WHEN count(*) > 0 THEN 1 ELSE 0 END AS status FROM ({MIXED_SQL})")
def exit_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Analysis(MIXED).diagnostics(docs(spark, sf_dir)).limit(1).agg(F.count("*").cast("int").alias("status"))


@query(
    WORD_PIECES
    + f"SELECT path || ':' || start_byte || '-' || end_byte || ': err: article' AS value FROM pieces WHERE t = 'the'"
)
def rendered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Analysis(WORDS + 'rules { rule R { match Word where Word.text == "the" report err at Word "article" } }')
    return D.rendered(a.diagnostics(docs(spark, sf_dir))).select("value")


@query(
    LINE_SQL
    + """, parts AS (
  SELECT path, line, 0 AS k, 0::BIGINT AS i, '  ' || '  ' || CASE WHEN ended THEN 'lines: Node Line' ELSE 'tail: Node Tail' END || ' [' || first_tok || ':' || (first_tok + n_tok) || ']' AS s FROM lines
  UNION ALL SELECT path, line, 1, i, '      ' || CASE WHEN NOT ended THEN 'words' WHEN row_number() OVER (PARTITION BY path, line ORDER BY i) = 1 THEN 'head' ELSE 'rest' END || ': Node W [' || tok || ':' || (tok + 1) || ']' FROM words),
bodies AS (SELECT path, string_agg(s, chr(10) ORDER BY line, k, i) AS body FROM parts GROUP BY path),
totals AS (SELECT path, count(*) AS n FROM toks GROUP BY path)
SELECT src.path, sha256('Tree' || chr(10) || '  Node Root [0:' || coalesce(n, 0) || ']' || coalesce(chr(10) || body, '')) AS tree_sha256 FROM src LEFT JOIN bodies USING (path) LEFT JOIN totals USING (path)"""
)
def print_ast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Analysis(LINES).trees(docs(spark, sf_dir)).select("path", F.sha2("tree", 256).alias("tree_sha256"))


@query(
    pieces(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+", "SELECT conv_id || '/' || turn || '.' || role AS path, coalesce(text, '') AS content FROM conversations")
    + f"SELECT path, {SUMS} FROM pieces WHERE {IS_WORD} AND path LIKE '%.user' AND strlen(t) >= 12 GROUP BY path"
)
def conversations_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Analysis(WORDS.replace(SCOPE, 'scope { include "*/*.user" }\n') + 'rules { rule R { match Word where Word.length >= 12 report info at Word "long" } }')
    return summed(a.diagnostics(tables.conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))), "path")


@query(
    pieces(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+", "SELECT 'events/' || event_type || '/' || event_id || '.json' AS path, coalesce(props, '') AS content FROM events")
    + f"SELECT path, {SUMS} FROM pieces WHERE {IS_NUMBER} GROUP BY path"
)
def events_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Analysis(WORDS + 'rules { rule R { match Number report info at Number "number" } }')
    return summed(a.diagnostics(tables.events(spark.read.parquet(f"{sf_dir}/events.parquet"))), "path")
