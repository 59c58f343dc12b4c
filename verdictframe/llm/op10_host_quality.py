"""Quality rules at the level of hosts, in DataFrame functions only.

Each document's facts are counted inside its row. Rule failures are summed by host, the rates are shrunk with a beta
prior that is fitted to all hosts, and a host whose shrunken rate is beyond a limit loses all its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash, text_of

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5
FACTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _shifted(a: Column, k: int) -> Column:
    """The array without its first ``k`` elements."""
    return F.slice(a, F.lit(k + 1), F.greatest(F.size(a) - k, F.lit(0)))


def _head(a: Column, k: int) -> Column:
    """The array without its last ``k`` elements."""
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - k, F.lit(0)))


def _pairs(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))


def facts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words to every row; other columns stay.

    Words are runs of anything but space and tab to carriage return. Null and empty texts have zeros. A line counts
    as repeated if it holds a word and equals an earlier line of the text. n_repeat_words counts the words that stand
    in a five-word window whose words occur there twice or more, first place included: windows are hashed, sorted with
    their places, and equal neighbours are marked, so a text of n words costs n log n. Existing columns of these five
    names are replaced; helper columns start with ``__q_``.
    """
    t = text_of(text)
    df = docs.withColumns({
        "__q_words": F.filter(F.split(t, SPACE), lambda w: w != ""),
        "__q_lines": F.filter(F.split(t, "\n"), lambda x: F.rtrim(F.translate(x, "\t\x0b\x0c\r", "    ")) != ""),
        "__q_chars": F.char_length(F.regexp_replace(t, SPACE, "")),
        "__q_symbols": F.char_length(t) - F.char_length(F.translate(t, "#*$%&|<>", "")),
    })
    df = df.withColumn("__q_one", F.transform("__q_words", lambda w: F.xxhash64(w)))
    one = F.col("__q_one")
    df = df.withColumn("__q_two", _pairs(_head(one, 1), _shifted(one, 1)))
    two = F.col("__q_two")
    df = df.withColumn("__q_four", _pairs(_head(two, 2), _shifted(two, 2)))
    df = df.withColumn("__q_five", _pairs(_head(F.col("__q_four"), 1), _shifted(one, 4)))
    five = F.col("__q_five")
    df = df.withColumn("__q_sorted", F.when(
        F.size(F.array_distinct(five)) < F.size(five),
        F.array_sort(F.transform(five, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    rank = F.col("__q_sorted")
    df = df.withColumn("__q_twins", F.zip_with(
        _head(rank, 1), _shifted(rank, 1),
        lambda a, b: F.when(a["g"] == b["g"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>"))))
    df = df.withColumn("__q_places", F.array_sort(F.array_distinct(F.flatten("__q_twins"))))
    place = F.col("__q_places")
    gaps = F.zip_with(_head(place, 1), _shifted(place, 1), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    df = df.withColumns({
        "n_words": F.size("__q_words").cast("long"),
        "word_chars": F.col("__q_chars").cast("long"),
        "n_symbols": F.col("__q_symbols").cast("long"),
        "n_dup_lines": (F.size("__q_lines") - F.size(F.array_distinct("__q_lines"))).cast("long"),
        "n_repeat_words": F.coalesce(F.aggregate(gaps, F.lit(WINDOW).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")),
    })
    return df.drop(*[c for c in df.columns if c.startswith("__q_")])


def base_failed(min_words: int = 10, max_repeat_percent: int = 20) -> Column:
    return (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)


def rules_failed() -> Column:
    """How many of the rules a document breaks: the two of ``base_failed``, symbols (more than one for ten words),
    repeated lines (more than ten and over three for ten words), word length (mean outside 2 to 15)."""
    w = F.greatest(F.col("n_words"), F.lit(1))
    broken = (
        F.col("n_words") < 10,
        F.col("n_repeat_words") * 100 > w * 20,
        F.col("n_symbols") * 10 > w,
        (F.col("n_dup_lines") > 10) & (F.col("n_dup_lines") * 10 > w * 3),
        (F.col("word_chars") < w * 2) | (F.col("word_chars") > w * 15),
    )
    total = F.lit(0)
    for b in broken:
        total = total + F.when(b, 1).otherwise(0)
    return total


def host_verdicts(rated: DataFrame, host: str, failed: str, max_rate: float = 0.9) -> DataFrame:
    """Per host: rows, failures, shrunken failure rate and verdict. Null is a host like any other.

    The beta prior has the mean of the hosts' rates and the strength that their spread implies (method of moments);
    hosts count by their rows. Without spread, or with one host, the prior is Beta(1, 1). Rows of one host are summed
    on the map side, so a host of any size is one small row per task.
    """
    n = rated.groupBy(F.col(host).alias("__h_host")).agg(
        F.count(F.lit(1)).alias("__h_n"), F.sum(F.col(failed).cast("long")).alias("__h_bad"))
    rate, weight = F.col("__h_bad") / F.col("__h_n"), F.col("__h_n").cast("double")
    sums = n.agg(
        F.sum(weight).alias("__h_w"), F.sum(F.col("__h_bad")).alias("__h_b"), F.count(F.lit(1)).alias("__h_hosts"),
        F.sum(weight * rate * rate).alias("__h_sq"))
    mean = F.col("__h_b") / F.col("__h_w")
    spread = F.greatest(F.col("__h_sq") / F.col("__h_w") - mean * mean, F.lit(0.0))
    noise = mean * (1 - mean) * F.col("__h_hosts") / F.col("__h_w")
    between = spread - noise
    strength = F.when((between > 1e-12) & (F.col("__h_hosts") > 1), F.greatest(mean * (1 - mean) / between - 1, F.lit(2.0))).otherwise(2.0)
    prior = sums.select(
        F.when(strength > 2.0, mean).otherwise(0.5).alias("__h_mean"), strength.alias("__h_k"))
    shrunk = (F.col("__h_bad") + F.col("__h_mean") * F.col("__h_k")) / (F.col("__h_n") + F.col("__h_k"))
    # the prior is one row
    return n.crossJoin(F.broadcast(prior)).select(
        "__h_host", F.col("__h_n").alias("__h_rows"), shrunk.alias("__h_rate"), (shrunk > max_rate).alias("__h_rejected"))


def judge(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = 0.9) -> DataFrame:
    """Facts and verdict of every row: doc_id, the five facts, base_failed, host, host_rate and kept.

    kept is false if base_failed, or if the host's shrunken failure rate is over ``max_rate``. Repeated rows are judged
    alike; an empty table gives an empty result. Facts are written once to the shared folder, so that texts are read
    once for both uses.
    """
    rated = facts(docs.select("doc_id", F.col(text).alias("text"), F.col(host).alias("host")), "text").drop("text")
    rated = stash(rated.withColumns({"base_failed": base_failed(), "n_broken": rules_failed()}).withColumn("failed", F.col("n_broken") > 0))
    hosts = host_verdicts(rated, "host", "failed", max_rate)
    out = rated.join(hosts, rated["host"].eqNullSafe(hosts["__h_host"]), "left")
    return out.select(
        "doc_id", *FACTS, "base_failed", (~F.col("base_failed") & ~F.coalesce("__h_rejected", F.lit(False))).alias("kept"),
        "host", "n_broken", F.round("__h_rate", 6).alias("host_rate"))


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = 0.9) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with the columns of ``docs``.

    Host verdicts come from one pass over the texts and document verdicts from a second; no text is shuffled unless
    a rejected host must be matched, and rejected hosts are the only rows of that join's small side.
    """
    view = facts(docs.select(F.col(text).alias("text"), F.col(host).alias("host")), "text")
    hosts = stash(host_verdicts(view.select("host", (rules_failed() > 0).alias("failed")), "host", "failed", max_rate))
    bad = hosts.where("__h_rejected").select("__h_host")
    own = docs.columns
    probe = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("__k_row"), F.col(text).alias("text"), F.col(host).alias("host"))
    # a filter on a projected column is rewritten in terms of the texts, which repeats nested expressions; a generator
    # of one element keeps the facts as they are
    judged = facts(probe, "text").select("__k_row", "host", F.explode(F.array(F.struct(*FACTS))).alias("f")).select("__k_row", "host", "f.*")
    good = judged.where(~base_failed())
    return good.join(bad, good["host"].eqNullSafe(bad["__h_host"]), "left_anti").select("__k_row.*")
