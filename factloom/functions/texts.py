"""Text functions of the memory layer: tokens, signals, fact blocks, logs, paths."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that name no entity.
STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would could should "
    "may might shall can need dare ought used to am i we you he she it they what which who "
    "this that these those my our your his her its their about above after all also and as at "
    "before but by for from if in into just me more most no not of on only or other our out "
    "same so than then there they through to too under up us very via was we what when where "
    "which while who why with"
).split()
#: Fixed value: shortest token, punctuation included, that may name an entity.
MIN_TOKEN = 4
#: Phrases that state a decision, preference, constraint or dependency, in order of precedence.
SIGNALS = (
    ("decision", r"we'?ll?\s+use\s+([\w\-]+)"),
    ("decision", r"going\s+with\s+([\w\-]+)"),
    ("decision", r"decided\s+(?:to\s+)?(?:use\s+)?([\w\-]+)"),
    ("decision", r"we\s+chose\s+([\w\-]+)"),
    ("preference", r"I\s+prefer\s+([\w\-]+)"),
    ("preference", r"I\s+don'?t\s+like\s+([\w\-]+)"),
    ("preference", r"always\s+use\s+([\w\-]+)"),
    ("preference", r"never\s+use\s+([\w\-]+)"),
    ("constraint", r"must\s+be\s+([\w\-]+)"),
    ("constraint", r"can'?t\s+use\s+([\w\-]+)"),
    ("constraint", r"prioritize\s+([\w\-]+)"),
    ("dependency", r"depends\s+on\s+([\w\-]+)"),
    ("dependency", r"requires?\s+([\w\-]+)"),
)
#: Phrases that ask about the past, and dates.
PAST = r"(?i)\b(last\s+\w+|yesterday|before|earlier|as\s+of|at\s+the\s+time|back\s+when|previously)\b"
DATE = r"\b(\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4})\b"
#: What an ingestion log says of skipped commits, faults and the correction sweep.
LOG_SKIP = r"^\[_run_ingestion\] skipping (?:unreadable )?commit (\S+)"
LOG_SWEEP = r"^\[_correction_sweep\] (\d+) entities left provisional/unreconciled this run"
LOG_FAULTS = (
    ("page_out_of_bounds", r"Page \d+ out of bounds"),
    ("serde_deserialization_error", r"Serde Deserialization Error"),
    ("stream_all_entries_expected_leaf_page", r"stream_all_entries: expected leaf page"),
    ("tee_stderr_pump_failed", r"\[tee_stderr\] pump failed:"),
)
#: Languages by file extension.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "tsx", ".rs": "rust", ".go": "go",
    ".java": "java", ".c": "c", ".cpp": "cpp", ".cs": "c_sharp", ".rb": "ruby", ".php": "php", ".kt": "kotlin", ".swift": "swift",
    ".scala": "scala", ".hs": "haskell", ".lua": "lua", ".ex": "elixir", ".exs": "elixir",
}
#: Paths that ingestion leaves out by default.
IGNORED = ("3rdParty/", "third_party/", "vendor/", "node_modules/", "dist/", "build/", "*.min.js", "*.map")
FACT = r'\[\s*(:[^\s\]"]+)\s+(:[^\s\]"]+)\s+("(?:\\.|[^"\\])*"|[^\s\]"]+)\s*\]'


def query_tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits of the lower-cased text; order and repeats stay."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def candidate_entities(text: Column) -> Column:
    """Tokens that may name an entity: long enough with their punctuation, no stop word, then stripped."""
    tokens = F.filter(F.split(F.btrim(F.regexp_replace(F.lower(text), r"\s+", " ")), " ", -1), lambda t: (F.length(t) >= MIN_TOKEN) & ~t.isin(*STOP_WORDS))
    return F.transform(tokens, lambda t: F.btrim(t, F.lit(".,?!;:\"'()[]")))


def past_signal(text: Column) -> Column:
    return text.rlike(PAST)


def first_date(text: Column) -> Column:
    """The first date in the text, or null."""
    d = F.regexp_extract(text, DATE, 1)
    return F.when(d != "", d)


def heuristic_extract(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, entity_type, value): what the signal phrases state; the first mention of a value and type in a text."""
    n = len(SIGNALS)
    found = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(t).alias("entity_type"), F.regexp_extract_all(F.col(text_col), F.lit(f"(?i){p}"), F.lit(1)).alias("values")) for i, (t, p) in zip(range(n), SIGNALS, strict=True)])
    hits = rows.select(id_col, F.explode(found).alias("h")).select(id_col, "h.rank", "h.entity_type", F.posexplode("h.values").alias("at", "value"))
    hits = hits.filter((F.length("value") >= 2) & ~F.lower("value").isin(*STOP_WORDS))
    return hits.groupBy(id_col, "entity_type", F.lower("value").alias("key")).agg(F.min_by("value", F.struct("rank", "at")).alias("value")).drop("key")


def parse_facts(rows: DataFrame, text_col: str) -> DataFrame:
    """Every ``[e a v]`` triple of a text block of flat facts: e, a, v_type, v."""
    pick = lambda k: F.regexp_extract_all(F.col(text_col), F.lit(FACT), F.lit(k))
    t = rows.select(F.explode(F.arrays_zip(pick(1).alias("e"), pick(2).alias("a"), pick(3).alias("v"))).alias("t")).select("t.e", "t.a", "t.v")
    kind = F.when(F.col("v").startswith('"'), "str").when(F.col("v").startswith(":"), "ref").when(F.col("v").isin("true", "false"), "bool").when(F.col("v").rlike(r"^[+-]?\d+$"), "int").when(F.col("v").rlike(r"^[+-]?\d*\.\d+$"), "float").otherwise("ref")
    text = F.regexp_replace(F.substring(F.col("v"), F.lit(2), F.length("v") - 2), r"\\(.)", "$1")
    return t.select("e", "a", kind.alias("v_type"), F.when(F.col("v").startswith('"'), text).otherwise(F.col("v")).alias("v"))


def scan_log(lines: DataFrame, run_col: str, line_col: str) -> DataFrame:
    """Per run: commits skipped, fault lines, sweep summaries and the largest of them (0 without one)."""
    line = F.col(line_col)
    faults = sum((line.rlike(p).cast("long") for _, p in LOG_FAULTS), F.lit(0))
    sweep = F.when(line.rlike(LOG_SWEEP), F.regexp_extract(line, LOG_SWEEP, 1).cast("long"))
    return lines.groupBy(run_col).agg(F.sum(line.rlike(LOG_SKIP).cast("long")).alias("skipped_commits"), F.sum(faults).alias("error_signals"), F.count(sweep).alias("sweep_summaries"), F.coalesce(F.max(sweep), F.lit(0)).alias("sweep_skipped"))


def _glob(pattern: str) -> str:
    return "^" + "".join({"*": ".*", "?": "."}.get(c, c if c in "[]" else re.escape(c)) for c in pattern) + "$"


def ignored_path(path: Column, patterns: tuple[str, ...] = IGNORED) -> Column:
    """A directory pattern (``x/``) names any segment, a glob the file name or whole path, others any segment."""
    segments, name = F.split(path, "/"), F.regexp_extract(path, "[^/]*$", 0)
    out = F.lit(False)
    for p in patterns:
        if p.endswith("/"):
            out = out | F.array_contains(segments, p.rstrip("/"))
        elif any(c in p for c in "*?["):
            out = out | name.rlike(_glob(p)) | path.rlike(_glob(p))
        else:
            out = out | F.array_contains(segments, p)
    return out


def language(path: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[F.regexp_extract(path, r"\.[^./]+$", 0)]


def parse_raw_diff(line: Column) -> Column:
    """``:old new sha sha STATUS[score]<tab>path[<tab>path]`` as a struct."""
    parts, head = F.split(line, "\t"), F.split(F.split(line, "\t")[0], " ")
    status = head[4]
    score = F.regexp_extract(status, r"\d+", 0)
    return F.struct(F.substring(head[0], 2, 6).alias("old_mode"), head[1].alias("new_mode"), F.substring(status, 1, 1).alias("status"), F.when(score != "", score.cast("int")).alias("score"), parts[1].alias("old_path"), F.coalesce(F.get(parts, F.lit(2)), parts[1]).alias("new_path"))


#: Language -> pattern of an import and what is kept of its name (``first`` dotted part, ``last`` part of a
#: path, the path's ``stem``, or the ``whole``).
IMPORTS = {
    "python": (r"(?m)^[ \t]*(?:import|from)[ \t]+([.\w]+)", "whole"),
    "javascript": (r"""(?m)(?:\bfrom[ \t]*|\brequire[ \t]*\([ \t]*|^[ \t]*import[ \t]*)['"]([^'"\n]+)['"]""", "whole"),
    "typescript": (r"""(?m)(?:\bfrom[ \t]*|\brequire[ \t]*\([ \t]*|^[ \t]*import[ \t]*)['"]([^'"\n]+)['"]""", "whole"),
    "tsx": (r"""(?m)(?:\bfrom[ \t]*|\brequire[ \t]*\([ \t]*|^[ \t]*import[ \t]*)['"]([^'"\n]+)['"]""", "whole"),
    "rust": (r"(?m)^[ \t]*(?:pub[ \t]+)?use[ \t]+(?:(?:crate|self|super)::)*(\w+)", "whole"),
    "go": (r'(?m)^[ \t]*(?:import[ \t]+)?(?:[\w.]+[ \t]+)?"([^"\n]+)"[ \t]*$', "last"),
    "java": (r"(?m)^[ \t]*import[ \t]+(?:static[ \t]+)?([\w.]+)", "first"),
    "kotlin": (r"(?m)^[ \t]*import[ \t]+([\w.]+)", "first"),
    "scala": (r"(?m)^[ \t]*import[ \t]+([\w.]+)", "first"),
    "haskell": (r"(?m)^[ \t]*import[ \t]+(?:qualified[ \t]+)?([\w.]+)", "first"),
    "swift": (r"(?m)^[ \t]*import[ \t]+(\w+)", "whole"),
    "c_sharp": (r"(?m)^[ \t]*using[ \t]+(?:static[ \t]+)?([\w.]+)[ \t]*;", "first"),
    "c": (r'(?m)^[ \t]*#[ \t]*include[ \t]*[<"]([^>"\n]+)[>"]', "stem"),
    "cpp": (r'(?m)^[ \t]*#[ \t]*include[ \t]*[<"]([^>"\n]+)[>"]', "stem"),
    "ruby": (r"""(?m)^[ \t]*require(?:_relative)?[ \t(]+['"]([^'"\n]+)['"]""", "stem"),
    "php": (r"""(?m)\b(?:include|require)(?:_once)?[ \t(]+['"]([^'"\n]+)['"]""", "stem"),
    "lua": (r"""(?m)\brequire[ \t(]+['"]([^'"\n]+)['"]""", "whole"),
    "elixir": (r"(?m)^[ \t]*(?:alias|import|use)[ \t]+([\w.]+)", "first"),
}


def imports_of(lang: Column, source: Column) -> Column:
    """The distinct names that a source imports, by its language's line patterns; no grammar and no user function."""
    keep = {
        "whole": lambda x: x,
        "first": lambda x: F.split(x, "[.]")[0],
        "last": lambda x: F.element_at(F.split(x, "/"), -1),
        "stem": lambda x: F.regexp_replace(F.element_at(F.split(x, "/"), -1), r"\.[^.]*$", ""),
    }
    out = F.array().cast("array<string>")
    for name, (pattern, part) in IMPORTS.items():
        out = F.when(lang == name, F.transform(F.regexp_extract_all(source, F.lit(pattern), F.lit(1)), keep[part])).otherwise(out)
    return F.array_sort(F.array_distinct(out))


def string_triples(rows: DataFrame, text_col: str) -> DataFrame:
    """(entity, entity_type, attribute, value) of the quoted triples of a block: what validation judges. Keyword values are left out."""
    pick = lambda k: F.regexp_extract_all(F.col(text_col), F.lit(r'\[(\S+)\s+(\S+)\s+"([^"]+)"\]'), F.lit(k))
    t = rows.select(F.explode(F.arrays_zip(pick(1).alias("e"), pick(2).alias("a"), pick(3).alias("v"))).alias("t"))
    kind = F.when(F.col("t.e").contains("/"), F.regexp_replace(F.split("t.e", "/")[0], "^:+", "")).otherwise("")
    return t.select(F.col("t.e").alias("entity"), kind.alias("entity_type"), F.col("t.a").alias("attribute"), F.col("t.v").alias("value"))


def cut(text: Column, most: int) -> Column:
    """The first ``most`` characters: 120 for descriptions, 200 for subjects."""
    return F.substring(text, 1, most)
