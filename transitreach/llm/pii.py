"""Personal data by weak-supervision aggregation.

Base spans (email, ip, card, phone) are found by their patterns.  The method adds
candidates of four looser kinds: spelled-out addresses (``mail_text``), phone-like
numbers without a plus (``number``), numbers in national-id form (``national_id``)
and capitalised names after a title or a given name (``name``).

Five labelers vote on every candidate, base ones too: yes, no or nothing.

* ``strict``: a regular expression of the kind's strict form;
* ``gazetteer``: known top-level domains, card prefixes, calling codes, area codes, given names;
* ``cue_before`` / ``cue_after``: words near the span that speak for or against;
* ``sound``: no digit repeated throughout, no digits or letters glued to the span.

Expectation-maximisation estimates, for every looser kind on its own, how common
personal data is and how often each labeler says yes for it and for the rest.  A
labeler that says yes no more often for personal data than for the rest is given one
rate for both, so it does not count for that kind.  Base spans are anchors: they are
personal data by definition and are not judged, and their votes are where the rates of
the labelers that treat all kinds alike (cues and ``sound``) start from and, with the
weight of ``ANCHOR`` spans, are drawn to.  It runs on the counts of the vote patterns
over all candidates: at most kinds * 3^5 rows, summed by Spark, whatever the corpus.
The posteriors then train the final classifier, a logistic regression over votes by
kind, length and the characters beside the span; again on the counts of feature
patterns, whose number is bounded by the features' values.  Added candidates with a
score of at least ``REPORT`` that do not overlap a base span are reported; base spans stay.

Edge cases: a NULL text counts as empty and has no spans.  Rows are scanned one
by one, so repeated rows and rows with a NULL doc_id give the same spans each.
Without candidates of the looser kinds the classifier reports nothing.  An empty table gives an empty
result.  Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_of
from .textspans import counted, listed, matches, spans

# ---- Fixed values: patterns of the base kinds and of the added ones, in order of rank.
# Possessive and guarded forms of the contract's patterns: a run that fails at its first
# character fails at every other, so it is tried once; the matches are the same.  A look
# ahead comes first where it turns most positions away cheaply.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "mail_text": r"(?i)(?<![a-z0-9._-])[a-z0-9._-]{2,64}\x20?[\[(]?(?:\x20at\x20|\(at\)|\[at\])[\])]?\x20?"
                 r"[a-z0-9-]{2,63}\x20?(?:\x20dot\x20|\(dot\)|\[dot\])\x20?[a-z]{2,10}",
    "number": r"(?=[0-9(])(?<![0-9+.,-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
    "national_id": r"(?=[0-9])(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "name": r"(?=[A-Z])(?<![A-Za-z])(?:(?:Mr|Mrs|Ms|Dr|Prof)\.\x20)?[A-Z][a-z]{1,20}\x20[A-Z][a-z]{1,20}(?![A-Za-z])",
}
# What a text must hold for a pattern to match at all: a cheap test before the costly ones.
NEEDS = {"email": r"@", "phone": r"\+[0-9]", "mail_text": r"(?i)[\[(\x20]dot[\])\x20]", "card": r"[0-9][\x20-]?[0-9]",
         "ip": r"[0-9]\.[0-9]", "number": r"[0-9][\x20.-][0-9]{3}", "national_id": r"-[0-9]{4}"}
BASE = ("email", "ip", "card", "phone")
KINDS = tuple(PATTERNS)
STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}$",
    "ip": r"^(0|[1-9][0-9]{0,2})(\.(0|[1-9][0-9]{0,2})){3}$", "card": r"^[0-9]{4}([\x20-]?[0-9]{4}){2,3}[0-9]{0,3}$",
    "phone": r"^\+[0-9]{1,3}[\x20-]?(\([0-9]+\)|[0-9]+)([\x20.-]?[0-9]+)*$", "mail_text": r"^[a-z0-9._-]+.*[a-z]{2,10}$",
    "number": r"^\([0-9]{3}\)[\x20.-][0-9]{3}[\x20.-][0-9]{4}$|^[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}$",
    "national_id": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "name": r"^(Mr|Mrs|Ms|Dr|Prof)\.\x20",
}
# Frequent given names of English, German, French, Spanish and Italian.
GIVEN_NAMES = (
    "Adam Alain Alan Albert Alexander Alice Amanda Amy Ana Andrea Andrew Angela Anita Ann Anna Anne Anthony Antonio Barbara "
    "Benjamin Bernard Bernd Betty Brian Bruno Carlos Carmen Carol Catherine Charles Charlotte Christian Christina Christopher "
    "Claire Claudia Cynthia Daniel David Deborah Dennis Diego Donald Donna Dorothy Edward Elena Elizabeth Emily Emma Eric Eva "
    "Fernando Francesca Francesco Francisco Frank Gary George Gerald Giovanni Giulia Hannah Hans Heather Helen Henry Isabel Jack "
    "Jacob James Jan Jane Jason Javier Jean Jeffrey Jennifer Jessica Joan Joe John Jonathan Jorge Jose Joseph Joshua Juan Julia "
    "Julie Karen Karl Katherine Kathleen Kenneth Kevin Klaus Larry Laura Linda Lisa Lucia Luis Manuel Marco Margaret Maria Marie "
    "Mario Mark Martha Martin Mary Matthew Melissa Michael Michelle Miguel Monica Nancy Nicolas Nicole Olivia Pablo Pamela Patricia "
    "Patrick Paul Pedro Peter Philippe Pierre Rachel Raymond Rebecca Richard Robert Rosa Ruth Ryan Samuel Sandra Sara Sarah Scott "
    "Sergio Sharon Simon Sofia Sophie Stefan Stephanie Stephen Steven Susan Teresa Thomas Timothy Victoria Walter William").split()
GENERIC_DOMAINS = "com org net edu gov mil int info biz name pro io dev app"
# Country calling codes by zone: one digit, then two, then blocks of three.
CALLING_CODES = (r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|"
                 r"(2[1-689]|3[578]|42|50|59|6[7-9]|8[0578]|9[679])[0-9]")
# Domains of two letters are countries'.  North American numbers have no area or exchange code below 200.  The first
# three digits of US social security numbers went up to 772 while they stood for an area.
GAZETTEER = {
    "email": r"(?i)\.(" + GENERIC_DOMAINS.replace(" ", "|") + r"|[a-z]{2})$", "ip": None,
    "card": r"^(4|5[1-5]|2[2-7]|3[47]|6(011|5))", "phone": rf"^\+({CALLING_CODES})(?![0-9]{{0,2}}0000)",
    "mail_text": r"(?i)[^a-z](" + GENERIC_DOMAINS.replace(" ", "|") + r"|[a-z]{2})$",
    "number": r"^\(?[2-9][0-8][0-9]\)?[\x20.-][2-9][0-9]{2}[\x20.-][0-9]{4}$",
    "national_id": r"^([0-6][0-9]{2}|7([0-6][0-9]|7[0-2]))-", "name": r"(^|\x20)(" + "|".join(GIVEN_NAMES) + r")\x20",
}
CUE_FOR = r"(?i)\b(e-?mail|mail|contact|reach|phone|tel|call|mobile|fax|card|visa|account|ip|address|host|ssn|name|mr|ms)\b"
CUE_AGAINST = r"(?i)\b(version|isbn|issn|order|invoice|page|figure|chapter|section|table|article|no)\b|[$€%]\s*$"
CONTEXT = 40
REPORT = 0.5
LABELERS = ("strict", "gazetteer", "cue_before", "cue_after", "sound")
ALIKE = (False, False, True, True, True)     # which labelers treat all kinds alike
ROUNDS = 100
ANCHOR = 20.0        # candidates that the anchors' rates weigh as much as
LEAST_GAIN = 0.05    # a labeler counts for a kind if its two rates differ by this


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    """Whether the 12 to 19 digits of ``m`` pass the Luhn sum."""
    d = _digits(m)

    def add(acc, i):
        x = F.substring(d, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, F.lit(2)).otherwise(F.lit(1))
        return acc + F.when(x > 9, x - 9).otherwise(x)

    total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add)
    return F.when(F.length(d).between(12, 19), total % 10 == 0).otherwise(False)


KEEP = {
    "ip": lambda m: m.rlike(r"^(0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(\.|$)){4}$"),
    "card": _luhn,
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
}


def candidates(docs: DataFrame) -> DataFrame:
    """``row, doc_id, base, added``: the spans of each row with their contexts."""
    found = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_of().alias("text"))
    for kind, pattern in PATTERNS.items():
        hits = matches(F.col("text"), pattern)
        if kind in NEEDS:
            hits = F.when(F.col("text").rlike(NEEDS[kind]), hits).otherwise(F.array().cast("array<string>"))
        found = found.withColumn(f"m_{kind}", hits)
    made = {kind: spans(F.col("text"), F.col(f"m_{kind}"), pattern, kind, rank, KEEP.get(kind), context=CONTEXT)
            for rank, (kind, pattern) in enumerate(PATTERNS.items())}
    return found.select("row", "doc_id", F.concat(*[made[k] for k in BASE]).alias("base"),
                        F.concat(*[made[k] for k in KINDS if k not in BASE]).alias("added"))


def _by_kind(rules: dict, test) -> Column:
    out = F.lit(None).cast("int")
    for kind, rule in rules.items():
        if rule is not None:
            out = F.when(F.col("kind") == kind, test(rule)).otherwise(out)
    return out


def _yes_no(c: Column) -> Column:
    return F.when(c, F.lit(1)).otherwise(F.lit(0))


def _cue(side: str) -> Column:
    return F.when(F.col(side).rlike(CUE_AGAINST), F.lit(0)).when(F.col(side).rlike(CUE_FOR), F.lit(1))


def voted(parts: DataFrame) -> DataFrame:
    """One row per candidate with the labelers' votes (1, 0, or -1 for none) and features."""
    rows = parts.select("row", F.explode(F.concat("base", "added")).alias("s")).select("row", "s.*")
    digits = _digits(F.col("text"))
    glued = F.col("left").rlike("[A-Za-z0-9]$") | F.col("right").rlike("^[A-Za-z0-9]")
    votes = {
        "strict": _by_kind(STRICT, lambda p: _yes_no(F.col("text").rlike(p))),
        "gazetteer": _by_kind(GAZETTEER, lambda p: _yes_no(F.col("text").rlike(p))),
        "cue_before": _cue("left"), "cue_after": _cue("right"),
        "sound": _yes_no(~(digits.rlike(r"^([0-9])\1{5,}$") | glued)),
    }

    def beside(c):
        return F.when(F.length(c) == 0, F.lit("edge")).when(c.rlike(r"\s"), F.lit("space")).when(
            c.rlike(r"\w"), F.lit("word")).otherwise(F.lit("mark"))

    return rows.select(
        "row", "start", "rank", "end", "kind", *[F.coalesce(v, F.lit(-1)).alias(n) for n, v in votes.items()],
        F.least(F.floor(F.log2((F.col("end") - F.col("start")).cast("double"))), F.lit(7)).cast("int").alias("size"),
        beside(F.right(F.col("left"), F.lit(1))).alias("before"), beside(F.left(F.col("right"), F.lit(1))).alias("after"))


class Reliabilities:
    """Dawid-Skene with abstaining labelers on counted vote patterns, each kind on its own."""

    def __init__(self, kinds: list[str], votes: np.ndarray, counts: np.ndarray):
        kinds = np.array(kinds)
        start = np.full(len(LABELERS), 0.8)
        known = np.isin(kinds, BASE)
        said = (counts[known, None] * (votes[known] >= 0)).sum(0)
        yes = (counts[known, None] * (votes[known] == 1)).sum(0)
        start = np.where(ALIKE & (said > 0), (yes + 4) / (said + 5), start)
        self.prior, self.yes = {}, {}
        for kind in KINDS:
            own = (kinds == kind) & ~known
            if own.any():
                self._fit(kind, votes[own], counts[own], start)

    def _fit(self, kind: str, votes: np.ndarray, counts: np.ndarray, start: np.ndarray) -> None:
        self.prior[kind], self.yes[kind] = 0.5, (start, np.full(len(LABELERS), 0.3))
        said, yes = counts[:, None] * (votes >= 0), counts[:, None] * (votes == 1)
        pull = np.where(ALIKE, ANCHOR, 5.0)
        pooled = (yes.sum(0) + 1) / (said.sum(0) + 2)
        for _ in range(ROUNDS):
            p = self._posterior(kind, votes)
            self.prior[kind] = float(((p * counts).sum() + 2) / (counts.sum() + 4))
            rates = [((w[:, None] * yes).sum(0) + pull * mean) / ((w[:, None] * said).sum(0) + pull)
                     for w, mean in ((p, start), (1 - p, 0.3))]
            silent = rates[0] - rates[1] < LEAST_GAIN
            self.yes[kind] = tuple(np.clip(np.where(silent, pooled, r), 1e-4, 1 - 1e-4) for r in rates)

    def _posterior(self, kind: str, votes: np.ndarray) -> np.ndarray:
        log = [np.log(prior) + np.where(votes == 1, np.log(y), np.where(votes == 0, np.log1p(-y), 0.0)).sum(1)
               for prior, y in zip((self.prior[kind], 1 - self.prior[kind]), self.yes[kind])]
        return 1 / (1 + np.exp(np.clip(log[1] - log[0], -50, 50)))

    def posterior(self, kinds, votes: np.ndarray) -> np.ndarray:
        """Of each pattern to be personal data; anchors are."""
        kinds, out = np.array(kinds), np.ones(len(votes))
        for kind in self.prior:
            out[kinds == kind] = self._posterior(kind, votes[kinds == kind])
        return out


FEATURES = ("kind", *LABELERS, "size", "before", "after")


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weighted logistic regression on soft labels, by Newton steps; a column of ones stands first."""
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (y - p)) - penalty * beta
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _value(feature: str, kind, value):
    """A feature's value; a vote counts by kind.  Of two columns, or of two pandas columns."""
    if feature not in LABELERS:
        return value
    return F.concat(kind, F.lit(":"), value.cast("string")) if isinstance(kind, Column) else kind + ":" + value.astype(str)


def fit(candidates: DataFrame) -> tuple[Reliabilities | None, dict[tuple[str, object], float]]:
    """The labelers' reliabilities and the classifier's weights by (feature, value); ("", "") is the constant."""
    # both tables have as many rows as there are patterns, which the features' values bound
    patterns = candidates.groupBy(*FEATURES).agg(F.count(F.lit(1)).alias("n")).toPandas()
    if patterns["kind"].isin(BASE).all():
        return None, {("", ""): -30.0}
    patterns = patterns.sort_values(list(FEATURES), kind="stable").reset_index(drop=True)
    votes = patterns.groupby(["kind", *LABELERS], as_index=False)["n"].sum()
    model = Reliabilities(list(votes["kind"]), votes[list(LABELERS)].to_numpy(), votes["n"].to_numpy(float))
    judged = patterns[~patterns["kind"].isin(BASE)].reset_index(drop=True)
    soft = model.posterior(list(judged["kind"]), judged[list(LABELERS)].to_numpy())
    values = {f: _value(f, judged["kind"], judged[f]) for f in FEATURES}
    columns = [(f, v) for f in FEATURES for v in sorted(values[f].unique())]
    x = np.column_stack([np.ones(len(judged)), *[(values[f] == v).to_numpy(float) for f, v in columns]])
    beta = fit_logistic(x, soft, judged["n"].to_numpy(float))
    return model, {("", ""): float(beta[0]), **{k: float(b) for k, b in zip(columns, beta[1:])}}


def score(weights: dict[tuple[str, object], float]) -> Column:
    terms = [F.when(_value(f, F.col("kind"), F.col(f)) == (v if isinstance(v, str) else int(v)), F.lit(w)).otherwise(F.lit(0.0))
             for (f, v), w in weights.items() if f]
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-reduce(lambda a, b: a + b, terms, F.lit(weights[("", "")]))))


def scan(docs: DataFrame) -> DataFrame:
    """``row, doc_id, base, found``: base spans and the added ones that are reported, per row."""
    spark = docs.sparkSession
    parts = materialise(spark, candidates(docs), "pii_candidates")
    votes = materialise(spark, voted(parts), "pii_votes")
    _, weights = fit(votes)
    likely = votes.where(~F.col("kind").isin(*BASE)).withColumn("score", score(weights)).where(F.col("score") >= REPORT)
    # overlap with base spans, in bins as wide as the context
    def binned(x):
        return x.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / CONTEXT),
                                                        F.floor((F.col("end") - 1) / CONTEXT))))

    known = binned(votes.where(F.col("kind").isin(*BASE)).select("row", "start", "end")).select(
        "row", "bin", F.col("start").alias("bs"), F.col("end").alias("be"))
    judged = binned(likely).join(known, ["row", "bin"], "left").groupBy("row", "start", "rank", "end", "kind").agg(
        F.max(F.coalesce((F.col("bs") < F.col("end")) & (F.col("be") > F.col("start")), F.lit(False))).alias("covered"))
    added = judged.where("NOT covered").groupBy("row").agg(
        F.collect_list(F.struct("start", "rank", "end", "kind")).alias("found"))
    bare = "array<struct<start:int,rank:int,end:int,kind:string>>"
    base = F.transform("base", lambda s: s.dropFields("text", "left", "right")).cast(bare)
    return parts.select("row", "doc_id", base.alias("base")).join(added, "row", "left").withColumn(
        "found", F.coalesce("found", F.array().cast(bare)))


def pii_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, n_added, base_sha256, spans`` of every row."""
    return scan(docs).select(
        "doc_id", *[counted(F.col("base"), k).alias(f"n_{k}") for k in BASE],
        F.size("found").cast("bigint").alias("n_added"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.concat("base", "found")).alias("spans"))
