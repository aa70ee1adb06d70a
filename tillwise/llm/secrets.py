"""Secret scans: candidates by shape, false positives removed by a random forest.

A candidate is, within a word,

* a run of ``LONG`` key characters or more, or
* a value of ``SHORT`` characters or more, of any signs, that is quoted, that a name
  is assigned to (``name = value``, ``name: value``), or that mixes letters, digits
  and other signs.

The forest looks at a candidate's length, the transitions between kinds of
characters, the share of it that dictionary words cover, the path (source) it was
found under and the words around it. The dictionary is the corpus's own: letter
runs that ``DICTIONARY_DOCS`` documents or more have. Everything is DataFrame
expressions and the DataFrame-based random forest of Spark; documents meet in a
shuffle only as distinct dictionary words.

The forest is trained on findings labelled 0 or 1, at most ``TRAIN_ROWS`` of each
kind in order of a hash; all candidates are scored. The labels are a table of
reviewed findings. Where there is none, weak labels stand in for it, made of
several formats (:func:`format_labels`); whether a value is quoted or assigned
takes part in them and is therefore no feature.

Defined cases: NULL and empty texts have no candidates. A NULL path is a path of
its own kind. Rows with NULL or repeated identifiers are scanned like any other; a
reviewed finding without identifier labels nothing, and of contradicting reviews 1
counts. Without labels of both kinds the probability is the share of label 1 (0
without labels). An empty table gives an empty result. Other columns are not
looked at.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.runtime import stored

LONG, SHORT = 16, 8
DICTIONARY_DOCS = 2
TRAIN_ROWS = 10_000
THRESHOLD = 0.5
TREES, DEPTH, SEED = 40, 8, 42

_RUN = f"[A-Za-z0-9+/_=-]{{{LONG},}}"
_KINDS = {"l": "[a-z]", "u": "[A-Z]", "d": "[0-9]", "s": "[^a-zA-Z0-9]"}
_PATH_BINS = 16
_QUOTES = "\"'`"
# A name that the rest of a word is assigned to, and words that assign to the next one.
_NAME = r"^[A-Za-z_][A-Za-z0-9_.-]*+(?:=>|:=|[=:])(?!//)"
_ASSIGNS = r"[=:]>?$"

# Formats that providers of keys document, and formats of what is no secret.
_PROVIDED = (
    r"^(?:AKIA|ASIA)[0-9A-Z]{16}$", r"^gh[pousr]_[A-Za-z0-9]{36,}$", r"^xox[abprs]-[A-Za-z0-9-]{10,}$",
    r"^[sr]k_(?:live|test)_[A-Za-z0-9]{16,}$", r"^AIza[A-Za-z0-9_-]{35}$", r"^glpat-[A-Za-z0-9_-]{20,}$",
)
_HARMLESS = (
    r"^[0-9]+$", r"^\p{L}+$", r"^[0-9]{1,4}[-/.:][0-9]{1,2}[-/.:][0-9T:.Z+-]*$", r"^v?[0-9]+(?:\.[0-9]+)+$",
    r"^[^@\s]+@[^@\s]+\.[A-Za-z]+$", r"^(?:https?:)?//\S*$", r"^\p{L}+(?:[-_/.]\p{L}+)+$",
)

# Words next to a candidate that speak for and against it.
_FOR = "token|secret|passw|pwd|apikey|api_key|key|auth|bearer|credential"
_AGAINST = "example|sample|dummy|test|placeholder|hash|sha|commit|checksum|digest|uuid"


def _any(value: Column, patterns: tuple[str, ...]) -> Column:
    return F.greatest(*(value.rlike(pattern) for pattern in patterns))


def _values(word: Column, before: Column) -> Column:
    """Structures ``value, quoted, assigned`` of the candidates in a word.

    Trimming and anchored patterns only: a word of any length is read once.
    """
    stripped = F.rtrim(F.ltrim(word, F.lit("([{<,;")), F.lit(")]}>,;.!?"))
    name = F.regexp_extract(stripped, _NAME, 0)
    body = F.substring(stripped, F.length(name) + 1, F.length(stripped))
    inside = F.regexp_extract(body, f"^([{_QUOTES}])([^{_QUOTES}]++)\\1", 2)
    quoted = inside != ""
    value = F.when(quoted, inside).otherwise(F.trim(body, F.lit(_QUOTES)))
    assigned = (name != "") | before.rlike(_ASSIGNS)
    mixes = value.rlike(r"\p{L}") & value.rlike("[0-9]") & value.rlike(r"[^\p{L}0-9]")
    one = F.when(
        (F.length(value) >= SHORT) & (quoted | assigned | mixes),
        F.array(F.struct(value.alias("value"), quoted.alias("quoted"), assigned.alias("assigned"))),
    ).otherwise(F.array())
    runs = F.regexp_extract_all(word, F.lit(f"({_RUN})"))
    others = F.filter(runs, lambda run: ~F.exists(one, lambda x: F.contains(x["value"], run)))
    bare = F.transform(others, lambda run: F.struct(run.alias("value"), F.lit(False).alias("quoted"), F.lit(False).alias("assigned")))
    return F.concat(one, bare)


def find_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """``doc_id, word_no, run_no, path, value, quoted, assigned, before2, before, word, after`` of every candidate."""
    words = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(path_col).cast("string").alias("path"),
        F.split(F.coalesce(F.col(text_col), F.lit("")), r"\s+").alias("words"),
    )
    near = lambda at, step: F.coalesce(F.get("words", at + step), F.lit(""))
    assigns = lambda word: F.right(word, F.lit(2)).rlike(_ASSIGNS)
    # Cheap questions first: most words are short or plain.
    hopeful = F.array_compact(
        F.transform(
            "words",
            lambda word, at: F.when(
                (F.length(word) >= SHORT)
                & (
                    word.rlike(f"[0-9=:{_QUOTES}]")
                    | ((F.length(word) >= LONG) & word.rlike(_RUN))
                    | assigns(near(at, -1))
                ),
                F.struct(at.alias("at"), word.alias("word"), near(at, -1).alias("before")),
            ),
        )
    )
    at = F.col("found.at")
    return (
        words.select("doc_id", "path", "words", F.explode(hopeful).alias("found"))
        .select(
            "doc_id", "path", at.alias("word_no"), F.col("found.word").alias("word"),
            near(at, -2).alias("before2"), F.col("found.before").alias("before"), near(at, 1).alias("after"),
        )
        .select("*", F.posexplode(_values(F.col("word"), F.col("before"))).alias("run_no", "found"))
        .select("doc_id", "word_no", "run_no", "path", "found.*", "before2", "before", "word", "after")
    )


def dictionary(docs: DataFrame, text_col: str = "text", least: int = DICTIONARY_DOCS) -> DataFrame:
    """``run``: lower-case runs of 3 to 24 letters that ``least`` documents or more have."""
    runs = F.array_distinct(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}]+"))
    return (
        docs.select(F.explode(runs).alias("run"))
        .filter(F.length("run").between(3, 24))
        .groupBy("run").agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= least)
        .select("run")
    )


def _covered(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """``value, covered``: the share of a value's characters in dictionary words, of values that have any."""
    values = candidates.select("value").distinct()
    runs = values.select("value", F.explode(F.split(F.lower("value"), r"[^\p{L}]+")).alias("run")).filter(
        F.length("run").between(3, 24)
    )
    return runs.join(known, "run").groupBy("value").agg((F.sum(F.length("run")) / F.length("value")).alias("covered"))


def _count(text: Column, what: str) -> Column:
    """How often the one or two different letters ``what`` occur."""
    return (F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))) / len(what)


def with_features(candidates: DataFrame, known: DataFrame) -> tuple[DataFrame, list[str]]:
    """``candidates`` with a column per feature, and the names of these."""
    kinds = F.col("value")
    # Symbols first: the letters that stand for kinds are letters themselves, so digits and symbols take capitals for now.
    for letter, pattern in (("#", _KINDS["s"]), ("0", _KINDS["d"]), ("l", _KINDS["l"]), ("u", _KINDS["u"])):
        kinds = F.regexp_replace(kinds, pattern, letter)
    shaped = candidates.withColumn("kinds", F.translate(kinds, "#0", "sd"))
    shaped = shaped.withColumn("runs", F.regexp_replace("kinds", r"(.)\1+", "$1"))
    length = F.length("value")
    steps = F.greatest(length - 1, F.lit(1))
    features: dict[str, Column] = {"f_length": length.cast("double")}
    for a in _KINDS:
        for b in _KINDS:
            pairs = _count(F.col("kinds"), a + b) if a != b else _count(F.col("kinds"), a) - _count(F.col("runs"), a)
            features[f"f_{a}{b}"] = pairs / steps
    features["f_distinct"] = F.size(F.array_distinct(F.split("value", ""))) / length
    path = F.coalesce(F.lower("path"), F.lit("\x00"))
    features["f_path_depth"] = F.size(F.split(path, "/")).cast("double")
    features["f_path_test"] = path.rlike("test|example|sample|doc").cast("double")
    features["f_path_bin"] = F.pmod(F.xxhash64(path), F.lit(_PATH_BINS)).cast("double")
    around = F.lower(F.concat_ws(" ", "before2", "before", "word"))
    rest = F.replace(around, F.lower("value"), F.lit(""))
    features["f_word_for"] = rest.rlike(_FOR).cast("double")
    features["f_word_against"] = F.concat_ws(" ", rest, F.lower("after")).rlike(_AGAINST).cast("double")
    made = shaped.select(*candidates.columns, *(column.alias(name) for name, column in features.items()))
    # Written tables on the other side, so that a frequent word or value can be split in the joins.
    covered = stored(_covered(candidates, stored(known, "dictionary")), "covered")
    made = made.join(covered, "value", "left").withColumn("covered", F.coalesce("covered", F.lit(0.0)))
    return made, [*features, "covered"]


def fit_forest(sample: DataFrame, names: list[str], trees: int = TREES):
    """The forest over ``sample``: columns ``label`` and ``names``."""
    together = VectorAssembler(inputCols=names, outputCol="features")
    return RandomForestClassifier(numTrees=trees, maxDepth=DEPTH, seed=SEED).fit(together.transform(sample))


def score_candidates(described: DataFrame, names: list[str], labels: Column, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Add ``probability`` of being a secret. ``labels``: 1, 0, or NULL for a finding that nobody labelled."""
    labelled = described.withColumn("label", labels.cast("double")).filter("label IS NOT NULL")
    order = [F.xxhash64("value", "doc_id", "word_no"), F.col("value")]
    sample = stored(
        labelled.filter("label = 1").orderBy(*order).limit(train_rows)
        .union(labelled.filter("label = 0").orderBy(*order).limit(train_rows))
        .select("label", *names),
        "findings",
    )
    count, positive = sample.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not count or positive in (0, count):
        return described.withColumn("probability", F.lit((positive or 0) / count if count else 0.0))
    together = VectorAssembler(inputCols=names, outputCol="features")
    scored = fit_forest(sample, names).transform(together.transform(described))
    return scored.withColumn("probability", vector_to_array("probability")[1])


def format_labels() -> Column:
    """Weak labels of findings, by format, where no reviewed ones exist.

    1: a value with letters and digits that is quoted and assigned to a name, or one
    in a format of keys that their providers document. 0: a value in a format of
    numbers, words, dates, versions, addresses or paths that is not quoted. What both
    or neither say something about stays without label.
    """
    value = F.col("value")
    secret = _any(value, _PROVIDED) | (F.col("quoted") & F.col("assigned") & value.rlike(r"\p{L}") & value.rlike("[0-9]"))
    harmless = _any(value, _HARMLESS) & ~F.col("quoted")
    return F.when(secret & ~harmless, 1).when(harmless & ~secret, 0)


def _reviewed(described: DataFrame, findings: DataFrame) -> DataFrame:
    """``described`` with ``reviewed``: the label that ``findings`` has for the same document and value."""
    known = stored(
        findings.filter("doc_id IS NOT NULL AND value IS NOT NULL AND label IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"), "value").agg(F.max("label").alias("reviewed")),
        "reviewed",
    )
    return described.join(known, ["doc_id", "value"], "left")


def scan_secrets(
    docs: DataFrame,
    findings: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    path_col: str = "source",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``doc_id, word_no, run_no, value, probability, is_secret`` of every candidate in ``docs``.

    ``findings``: ``doc_id, value, label`` of reviewed findings, 1 for a secret and 0 for
    a false positive. Without it the forest learns from weak labels.
    """
    candidates = stored(find_candidates(docs, id_col, text_col, path_col), "candidates")
    described, names = with_features(candidates, dictionary(docs, text_col))
    described = stored(described if findings is None else _reviewed(described, findings), "described")
    labels = format_labels() if findings is None else F.col("reviewed")
    return score_candidates(described, names, labels).select(
        "doc_id", "word_no", "run_no", "value", "probability", (F.col("probability") >= threshold).alias("is_secret")
    )
