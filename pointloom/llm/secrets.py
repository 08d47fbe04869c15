"""Secret scan: a trigram inverted index picks candidates, regexes verify them.

Each rule's regex gives a Boolean query over trigrams that all its matches
hold. ``index`` goes over each text once and writes posting lists: for a block
of ``BLOCK`` rows and a trigram that any rule asks for, the places in the block
whose text holds it. ``candidates`` puts a block's lists side by side and
intersects and unites them as the queries say; only the rows that are left meet
their texts again and are searched with the rule's regex. A rule without
mandatory trigrams searches every row. Texts are shuffled once, to meet the
candidates' numbers; those grow with the table, so they are never broadcast.

Positions count code points, the end is exclusive. Matches of a rule are
leftmost and do not overlap; those whose value is too short are dropped after
matching. Defined cases: a null text is empty and has no spans; a very long
text is searched whole; repeated rows are scanned each; other columns are
carried along, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.llm import common, trigrams

MARK = "<secret>"


def _either_case(word: str) -> str:
    return "".join(f"[{x}{x.upper()}]" if x.isalpha() else x for x in word)


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Matches whose ``group`` is shorter are dropped.
    least: int
    group: int = 0
    base: bool = False


_NAMES = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
RULES = (
    Rule("assign", f"({_NAMES})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 8, 2, True),
    Rule("access", "AKIA[A-Z0-9]+", 16, 0, True),
    # runs shorter than 32 cannot hold a longer one, so the bound may stand in the pattern
    Rule("hex", "[0-9a-f]{32,}", 32, 0, True),
    Rule("forge", "gh[oprsu]_[A-Za-z0-9]{36,}", 40),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]{10,}", 15),
    Rule("cloud", "AIza[0-9A-Za-z_-]{35}", 39),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", 29),
    Rule("pem", "-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----", 27),
)
#: After a PEM header: all up to the END line or, where that is missing, the lines of base64 and of encryption headers.
_PEM_BODY = (
    "(?:[^-]*+(?:-{1,4}[^-]++){0,64}+-----END [A-Z ]{0,24}PRIVATE KEY-----"
    r"|(?:(?:[\x20\t\r\n]|\\[nr])*+(?:(?:Proc-Type|DEK-Info):[^\n]*+|[A-Za-z0-9+/=]{16,}+|[A-Za-z0-9+/=]++(?=[\x20\t\r]*(?:\n|$|\\[nr])))){0,1000}+)"
)
#: Rules for redaction. Those above state ``op10_secrets`` and its SQL, where ``pem`` is the header alone.
REDACTION = tuple(Rule(r.kind, r.pattern + _PEM_BODY, r.least) if r.kind == "pem" else r for r in RULES)


#: Rows of a block: its posting lists are bounded by that, whatever the table holds. A power of two.
BLOCK = 4096


def _any_of(wanted: list[str]) -> str:
    """A pattern that finds the wanted trigrams at every place, overlapping ones too, in one pass."""
    by_first: dict[str, list[str]] = {}
    for t in wanted:
        by_first.setdefault(t[0], []).append(re.escape(t[1:]))
    starts = "".join(re.escape(k) for k in by_first)
    return f"(?=[{starts}])(?=(" + "|".join(f"{re.escape(k)}(?:{'|'.join(v)})" for k, v in by_first.items()) + "))"


def index(texts: DataFrame, wanted: list[str]) -> DataFrame:
    """block, trigram, places: the posting lists of ``texts`` (n: long, t) for the ``wanted`` trigrams, in ascending order."""
    held = F.array_distinct(F.regexp_extract_all(F.lower("t"), F.lit(_any_of(wanted)), F.lit(1)))
    d = texts.select("n", F.explode(held).alias("trigram"))
    block, place = F.shiftright("n", BLOCK.bit_length() - 1), F.col("n").bitwiseAND(F.lit(BLOCK - 1)).cast("int")
    return d.groupBy(block.alias("block"), "trigram").agg(F.sort_array(F.collect_list(place)).alias("places"))


def _places(q, lists: str) -> str:
    """SQL of the places that are left of a block: posting lists intersected and united."""
    if isinstance(q, str):
        literal = q.replace("\\", "\\\\").replace("'", "\\'")
        return f"coalesce({lists}['{literal}'], cast(array() AS array<int>))"
    kind, parts = q
    out = _places(parts[0], lists)
    for p in parts[1:]:
        out = f"array_{'intersect' if kind == 'and' else 'union'}({out}, {_places(p, lists)})"
    return out


def candidates(postings: DataFrame, queries: list) -> DataFrame:
    """n, rules: the rows that a query leaves, and the numbers of those queries; queries without trigrams are left out."""
    lists = postings.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "places"))).alias("lists"))
    asked = ", ".join(f"struct({i} AS rule, {_places(q, 'lists')} AS places)" for i, q in enumerate(queries) if q is not True)
    d = lists.select("block", F.explode(F.expr(f"array({asked})")).alias("r")).select("block", "r.rule", F.explode("r.places").alias("place"))
    n = F.shiftleft("block", BLOCK.bit_length() - 1).bitwiseOR(F.col("place").cast("long"))
    return d.groupBy(n.alias("n")).agg(F.collect_set("rule").alias("rules"))


_SPAN = "struct<start: bigint, rule: int, end: bigint>"


def _found(rule: Rule, text: Column) -> Column:
    pattern = F.lit(rule.pattern)
    return F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("match"), F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("value")
    )


def _spans(column: str, rule: Rule, number: int) -> str:
    return (
        f"aggregate({column}, named_struct('at', 0L, 'out', cast(array() AS array<{_SPAN}>)), (a, z) -> CASE WHEN z.match IS NULL THEN a ELSE named_struct("
        f"'at', a.at + char_length(z.gap) + char_length(z.match), 'out', CASE WHEN char_length(z.value) < {rule.least} THEN a.out ELSE concat(a.out, array(named_struct("
        f"'start', a.at + char_length(z.gap), 'rule', {number}, 'end', a.at + char_length(z.gap) + char_length(z.match)))) END) END, a -> a.out)"
    )


def _all_spans(rules: tuple[Rule, ...], numbers: list[int]) -> Column:
    return F.expr("concat(" + ", ".join(f"coalesce({_spans(f'm{i}', rules[i], i)}, cast(array() AS array<{_SPAN}>))" for i in numbers) + ")")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (the columns of ``docs``, or ``keep`` of them), ``t`` (its text) and ``spans``: (start, rule, end) in order of start, then rule."""
    queries = [trigrams.query(r.pattern) for r in rules]
    wanted = sorted(set().union(*map(trigrams.trigrams, queries)))
    kept = docs.columns if keep is None else keep
    row = F.struct(*[F.col(f"`{c}`") for c in kept])
    # the numbers of rows are written down, so each later reading sees the same ones
    apart = [] if text_col in kept else [F.col(text_col).alias("text")]
    d = common.staged(docs.select(F.monotonically_increasing_id().alias("n"), row.alias("row"), *apart), "secret-rows")
    text = common.whole_text(F.col("text") if apart else F.col(f"row.`{text_col}`"))
    if wanted:
        left = candidates(common.staged(index(d.select("n", text.alias("t")), wanted), "secret-postings"), queries)
        # candidates grow with the table: their rows and the texts meet in one shuffled join at every size
        d = d.join(left.hint("shuffle_hash"), "n", "left")
    else:
        d = d.withColumn("rules", F.array().cast("array<int>"))
    d = d.select("row", text.alias("t"), "rules")
    asked = [F.lit(True) if q is True else F.coalesce(F.array_contains("rules", i), F.lit(False)) for i, q in enumerate(queries)]
    d = d.select("row", "t", *[F.when(asked[i] & F.col("t").rlike(r.pattern), _found(r, F.col("t"))).alias(f"m{i}") for i, r in enumerate(rules)])
    return common.sealed(d.withColumn("spans", F.array_sort(_all_spans(rules, list(range(len(rules)))))), ["row", "t"], ["spans"])


def listed(spans: str, rules: tuple[Rule, ...] = RULES, base: bool = False) -> Column:
    """kind:start:end of the spans (of base rules only), joined by commas."""
    kinds = ", ".join(f"'{r.kind}'" for r in rules)
    keep = f"filter({spans}, s -> s.rule IN ({', '.join(str(i) for i, r in enumerate(rules) if r.base)}))" if base else spans
    return F.expr(f"array_join(transform({keep}, s -> concat(array({kinds})[s.rule], ':', s.start, ':', s.end)), ',')")


def count_of(spans: str, kind: str, rules: tuple[Rule, ...] = RULES) -> Column:
    number = [r.kind for r in rules].index(kind)
    return F.expr(f"cast(size(filter({spans}, s -> s.rule = {number})) AS bigint)")


def redacted(text: str, spans: str, mark: str = MARK) -> Column:
    """The text with each span, or union of spans that overlap, replaced by ``mark``."""
    upto = f"aggregate({spans}, named_struct('at', 0L, 'out', cast(array() AS array<string>)), (a, s) -> CASE WHEN s.start < a.at THEN named_struct('at', greatest(a.at, s.end), 'out', a.out)"
    step = f" ELSE named_struct('at', s.end, 'out', concat(a.out, array(substring({text}, cast(a.at AS int) + 1, cast(s.start - a.at AS int)), '{mark}'))) END,"
    end = f" a -> concat(array_join(a.out, ''), substring({text}, cast(a.at AS int) + 1)))"
    return F.expr(f"CASE WHEN size({spans}) = 0 THEN {text} ELSE {upto}{step}{end} END")


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL of the scan's digest, without an index: every rule searches every text."""
    parts = []
    for i, r in enumerate(rules):
        p = r.pattern.replace("'", "''")
        parts.append(
            f"SELECT rid, {i} AS rule, '{r.kind}' AS kind, {r.base} AS base, unnest(range(1, len(regexp_extract_all(t, '{p}', 0)) + 1)) AS i, unnest(string_split_regex(t, '{p}')[1:len(regexp_extract_all(t, '{p}', 0))]) AS gap,"
            f" unnest(regexp_extract_all(t, '{p}', 0)) AS match, unnest(regexp_extract_all(t, '{p}', {r.group})) AS value, {r.least} AS least FROM d"
        )
    return (
        "WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), m AS (" + " UNION ALL ".join(parts) + "), "
        "p AS (SELECT *, CAST(sum(length(gap) + length(match)) OVER (PARTITION BY rid, rule ORDER BY i) AS BIGINT) AS stop FROM m), "
        "s AS (SELECT rid, rule, kind, base, stop - length(match) AS start, stop FROM p WHERE length(value) >= least), "
        "g AS (SELECT rid, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c, count(*) FILTER (kind = 'hex') AS h, "
        "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rule) FILTER (base) AS b, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rule) AS al FROM s GROUP BY rid) "
        "SELECT doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(c, 0) AS BIGINT) AS n_access, CAST(coalesce(h, 0) AS BIGINT) AS n_hex, "
        "sha256(coalesce(b, '')) AS base_sha256, coalesce(al, '') AS spans FROM d LEFT JOIN g USING (rid)"
    )
