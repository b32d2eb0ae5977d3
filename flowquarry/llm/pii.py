"""Personal data by weak supervision: labelers vote, their reliabilities are estimated, a span classifier decides.

Base spans of four kinds (email, ip, card, phone) always stay. Wider patterns give more candidates. Every candidate, base
or not, gets votes for, against or none from four labelers: a gazetteer (domains, issuer numbers, calling and area codes,
networks), cue words for and against before it, variety of its characters, and form (check sum, like separators, well-formed
domains and groups). No labeler knows whether a candidate is base. Expectation-maximisation over the counts of vote patterns
estimates each labeler's reliability per kind from all candidates, and how common personal data is among the base and among
the wide candidates apart, so the many base spans say nothing for the wide ones. The wide candidates, with the pattern's
probability as a soft label, train a logistic classifier over features of the span; those it accepts are added. Every
combination of features also counts as a small part of an example, with the label its votes give it, so a kind whose texts
hold no counter-example still has a classifier that can say no.

Only DataFrame functions touch the data. The driver gets one count per pattern of votes and features, whose number is
bounded by their values; the classifier goes back as an expression.

Cases: null and empty texts have no spans; equal rows are scanned alike and each is returned; overlapping spans of
different kinds are all returned, and redacted as one; a kind without candidates is judged by the prior reliabilities; an
empty table gives an empty table; other columns keep their values, and only the output columns' own names are replaced.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from flowquarry.llm.text import let, spans

KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
# possessive forms of the base patterns: a run is tried from its first character, or from the end of the last match
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTETS = r"^0*+(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])?(?:\.0*+(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])?){3}$"
WIDE = {
    "email": rf"(?<!{LOCAL}){LOCAL}++\x20?[\[(](?i:at)[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(](?i:dot)[\])])\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
#: Gazetteers and cues.
DOMAINS = r"(?i)[.)\]]\x20?(?:com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu|ch|at)$"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)"
CODES = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
RESERVED = r"^(?:0\.|127\.|22[4-9]\.|23[0-9]\.|24[0-9]\.|25[0-5]\.)"
NETWORKS = r"^(?:[23][0-9A-Fa-f]{3}|[fF][cCdDeE][0-9A-Fa-f]{2}):"
AREAS = r"^\(?[2-9][0-9]{2}\)?[\x20.-][2-9]"
FORMS = {
    ("email", True): r"[A-Za-z].*\.[A-Za-z]{2,24}$", ("email", False): r"^[^@]*[A-Za-z].*[\x20.)\]][A-Za-z]{2,24}$",
    ("ip", True): r"^(?:0|[1-9][0-9]*)(?:\.(?:0|[1-9][0-9]*)){3}$", ("ip", False): r"(?:[0-9A-Fa-f]{4}:){2}|:[0-9A-Fa-f]{4}:(?:.*:)?[0-9A-Fa-f]{4}",
    ("phone", True): r"^\+[1-9][^(]*(?:\([0-9]+\)[^(]*)?$", ("phone", False): r"^(?:\([0-9]{3}\)[\x20.-][0-9]{3}[.-]|[0-9]{3}([.-])[0-9]{3}\1)[0-9]{4}$",
}
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|courriel|correo)\b", "ip": r"(?i)\b(?:ip|host|server|address|client|adresse)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|credit|payment|carte|tarjeta|karte)\b", "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|cell|telefon|tel[eé]fono)\b",
}
AGAINST = r"(?i)\b(?:order|invoice|version|isbn|serial|item|page|section|ticket|build|release|ref|sku|part|ratio|score)\b"
CONTEXT = 40
VOTES = ("v_gazetteer", "v_cue", "v_variety", "v_form")
FEATURES = ("f_gazetteer", "f_cue", "f_against", "f_varied", "f_form", "f_separated", "f_long")
#: Before any data: how often a labeler votes for, not at all and against what is personal data (and the other way round for
#: what is not), and counts of personal and other candidates.
PRIOR_VOTES = {1: 2.0, 0: 1.0, -1: 0.5}
PRIOR_SHARE = {1: 2.0, 0: 3.0}
PART = 0.25


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a text of digits passes the check sum."""
    def value(text: Column) -> Column:
        places = F.sequence(F.lit(1), F.length(text))
        return F.aggregate(places, F.lit(0), lambda acc, i: acc + let(
            F.substr(text, F.length(text) - i + 1, F.lit(1)).cast("int"), lambda d: F.when(i % 2 == 1, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))))
    return let(digits, lambda d: F.when(F.length(d) > 0, value(d) % 10 == 0).otherwise(True))


def base_spans(text: Column) -> Column:
    """Struct of the four arrays of base spans, and the digit runs that are no card."""
    runs = spans(text, CARD, only=text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"))
    ips = F.filter(spans(text, IP, only=text.rlike(r"[0-9]\.[0-9]++\.[0-9]")), lambda x: x["hit"].rlike(OCTETS))
    phones = F.filter(spans(text, PHONE, only=F.contains(text, F.lit("+"))), lambda x: F.length(_digits(x["hit"])).between(8, 15))
    return F.struct(spans(text, EMAIL, only=F.contains(text, F.lit("@"))).alias("email"), ips.alias("ip"), runs.alias("runs"), phones.alias("phone"))


def _is_card(x: Column) -> Column:
    return let(_digits(x["hit"]), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False))


def candidates(text: Column) -> Column:
    """Array of candidate spans with kind, base, start, stop, votes and features."""

    def judged(kind: str, base: bool, found: Column) -> Column:
        def one(x: Column) -> Column:
            before = F.lower(F.substr(text, F.greatest(x["start"] - CONTEXT, F.lit(0)) + 1, F.least(x["start"], F.lit(CONTEXT))))
            known = {"email": x["hit"].rlike(DOMAINS), "ip": ~x["hit"].rlike(RESERVED) if base else x["hit"].rlike(NETWORKS),
                     "card": _digits(x["hit"]).rlike(ISSUERS), "phone": x["hit"].rlike(CODES if base else AREAS)}[kind]
            form = x["hit"].rlike(FORMS[kind, base]) if kind != "card" else F.lit(True) if base else luhn(_digits(x["hit"]))
            varied = F.size(F.array_distinct(F.split(x["hit"], ""))) >= 5
            number = lambda c: F.coalesce(c, F.lit(False)).cast("int")
            return let(before, lambda b: let(F.struct(known.alias("known"), b.rlike(CUES[kind]).alias("cue"), b.rlike(AGAINST).alias("against"), varied.alias("varied"), form.alias("form")), lambda y: F.struct(
                F.lit(kind).alias("kind"), F.lit(base).alias("base"), x["start"].alias("start"), x["stop"].alias("stop"),
                F.when(y["known"], 1).otherwise(-1).alias("v_gazetteer"),
                F.when(y["cue"], 1).when(y["against"], -1).otherwise(0).alias("v_cue"), F.when(y["varied"], 0).otherwise(-1).alias("v_variety"), F.when(y["form"], 1).otherwise(-1).alias("v_form"),
                number(y["known"]).alias("f_gazetteer"), number(y["cue"]).alias("f_cue"), number(y["against"]).alias("f_against"), number(y["varied"]).alias("f_varied"), number(y["form"]).alias("f_form"),
                number(x["hit"].rlike(r"[\x20()-]")).alias("f_separated"), number(x["stop"] - x["start"] >= 16).alias("f_long"))))
        return F.transform(found, one)

    def every(f: Column) -> Column:
        cards = F.filter(f["runs"], _is_card)
        others = F.filter(f["runs"], lambda x: F.length(_digits(x["hit"])).between(13, 19) & ~_is_card(x))
        phones = F.filter(spans(text, WIDE["phone"], only=text.rlike(r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}")),
                          lambda x: ~F.exists(f["phone"], lambda y: (y["start"] < x["stop"]) & (x["start"] < y["stop"])))
        return F.concat(
            judged("email", True, f["email"]), judged("ip", True, f["ip"]), judged("card", True, cards), judged("phone", True, f["phone"]),
            judged("email", False, spans(text, WIDE["email"], only=text.rlike(r"(?i)[\[(]at[\])]"))),
            judged("ip", False, spans(text, WIDE["ip"], only=text.rlike("(?:[0-9A-Fa-f]{1,4}:){7}"))),
            judged("card", False, others), judged("phone", False, phones))

    return let(base_spans(text), every)


def estimate(counts: dict[tuple, float], rounds: int = 60, votes: Callable[[tuple], tuple] = lambda p: p, group: Callable[[tuple], object] = lambda p: None) -> dict[tuple, float]:
    """By pattern: how likely it is true, with reliabilities of the labelers by expectation-maximisation.

    ``votes`` gives a pattern's votes, ``group`` what it shares its prior with. A labeler that does not vote has no say on a pattern, and a pattern counted 0 gets a belief
    but has none on the labelers.
    """
    if not counts:
        return {}
    width = len(votes(next(iter(counts))))
    belief = {p: min(0.95, max(0.05, 0.5 + sum(votes(p)) / (2 * width))) for p in counts}
    for _ in range(rounds):
        total = {(group(p), y): PRIOR_SHARE[y] for p in counts for y in (0, 1)}
        seen = {(y, j, v): PRIOR_VOTES[v if y else -v] for y in (0, 1) for j in range(width) for v in (-1, 0, 1)}
        for p, n in counts.items():
            for y, share in ((1, belief[p]), (0, 1 - belief[p])):
                total[group(p), y] += n * share
                for j, v in enumerate(votes(p)):
                    seen[y, j, v] += n * share
        every = {(y, j): sum(seen[y, j, v] for v in (-1, 0, 1)) for y in (0, 1) for j in range(width)}
        for p in counts:
            score = {y: math.log(total[group(p), y]) + sum(math.log(seen[y, j, v] / every[y, j]) for j, v in enumerate(votes(p)) if v) for y in (0, 1)}
            belief[p] = 1 / (1 + math.exp(max(-50.0, min(50.0, score[0] - score[1]))))
    return belief


def train(rows: list[tuple[tuple, float, float]], rounds: int = 400, rate: float = 1.0) -> list[float]:
    """Logistic weights (the first for the constant) from (features, soft label, count)."""
    weights = [0.0] * (1 + len(FEATURES))
    every = sum(n for _, _, n in rows) or 1
    for _ in range(rounds):
        slope = [0.01 * w for w in weights]
        for x, y, n in rows:
            z = weights[0] + sum(w * f for w, f in zip(weights[1:], x, strict=True))
            error = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y) * n / every
            slope[0] += error
            for i, f in enumerate(x, 1):
                slope[i] += error * f
        weights = [w - rate * s for w, s in zip(weights, slope, strict=True)]
    return weights


def _combinations() -> list[tuple[tuple, tuple]]:
    """Votes and features of every kind of candidate there can be."""
    out = []
    for known, cue, varied, form, separated, long_ in itertools.product((0, 1), (-1, 0, 1), (0, 1), (0, 1), (0, 1), (0, 1)):
        votes = (2 * known - 1, cue, varied - 1, 2 * form - 1)
        out.append((votes, (known, int(cue == 1), int(cue == -1), varied, form, separated, long_)))
    return out


def fit(docs: DataFrame) -> dict[str, list[float]]:
    """Classifier weights per kind, from the counts of vote and feature patterns over all candidates of all texts."""
    names = ["kind", "base", *VOTES, *FEATURES]
    rows = docs.select(F.explode(candidates(F.col("text"))).alias("c")).groupBy(*[F.col(f"c.{n}").alias(n) for n in names]).count().collect()
    model = {}
    for kind in KINDS:
        own = sorted((bool(r["base"]), tuple(r[v] for v in VOTES), tuple(r[f] for f in FEATURES), r["count"]) for r in rows if r["kind"] == kind)
        counts: dict[tuple, float] = {(False, votes): 0 for votes, _ in _combinations()}
        for base, votes, _, n in own:
            counts[base, votes] = counts.get((base, votes), 0) + n
        belief = estimate(counts, votes=lambda p: p[1], group=lambda p: p[0])
        parts = [(features, belief[False, votes], PART) for votes, features in _combinations()]
        model[kind] = train(parts + [(features, belief[False, votes], n) for base, votes, features, n in own if not base])
    return model


def personal_spans(text: Column, model: dict[str, list[float]]) -> Column:
    """Array of (kind, base, start, stop): base spans, and candidates that the classifier accepts."""
    def accepted(x: Column) -> Column:
        score = F.lit(0.0)
        for kind, weights in model.items():
            value = F.lit(float(weights[0]))
            for w, name in zip(weights[1:], FEATURES, strict=True):
                value = value + x[name] * float(w)
            score = F.when(x["kind"] == kind, value).otherwise(score)
        return x["base"] | (score >= 0)
    short = lambda x: F.struct(x["kind"].alias("kind"), x["base"].alias("base"), x["start"].alias("start"), x["stop"].alias("stop"))
    return F.transform(F.filter(candidates(text), accepted), short)


def find_personal(docs: DataFrame, model: dict[str, list[float]] | None = None, into: str = "personal") -> DataFrame:
    """``docs`` with an array column ``into``; fits the model over all texts unless one is given. No shuffle of texts."""
    model = model or fit(docs)
    return docs.withColumn(into, personal_spans(F.col("text"), model))


def listed(found: Column) -> Column:
    """kind:start:stop texts by kind as listed, then start, joined by commas."""
    ranked = F.array_sort(F.transform(found, lambda x: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]).alias("rank"), x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind"))))
    return F.array_join(F.transform(ranked, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind in brackets; n_chars, where there is one, follows."""
    text = F.col("text")
    found = find_personal(docs, into="__personal")
    by_start = F.array_sort(F.transform("__personal", lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind"))))
    none = F.array().cast("array<struct<start:bigint,stop:bigint,kind:string>>")

    def join(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["stop"], x["stop"]).alias("stop"), last["kind"].alias("kind"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["stop"] > x["start"]), grown).otherwise(F.concat(done, F.array(x)))

    def pieces(whole: Column, cuts: Column) -> Column:
        begin = lambda i: F.coalesce(F.get(cuts, i - 1)["stop"], F.lit(0))
        kept = F.transform(cuts, lambda x, i: F.concat(F.substr(whole, (begin(i) + 1).cast("int"), (x["start"] - begin(i)).cast("int")), F.lit("["), F.upper(x["kind"]), F.lit("]")))
        return F.concat(F.array_join(kept, ""), F.substr(whole, (F.element_at(cuts, -1)["stop"] + 1).cast("int")))

    merged = F.aggregate(by_start, none, join)
    out = found.withColumn("text", F.when(F.size("__personal") > 0, let(merged, lambda cuts: pieces(text, cuts))).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("__personal") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
