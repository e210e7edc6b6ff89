"""The lexicon rule engine: phrases, words, modifiers, irrealis blockers, clauses and repetition, with its evidence.

Full scoring depends on greedy phrase consumption and on token distances, so it runs over Arrow batches; the compiled
rules travel with the function once for each task. `word_scores` is the native form of its word part.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CLAUSE_WEIGHTS, LABELS, MAX_ABS, NEGATION_SHIFT, NEGATIVE_WEIGHT, NEUTRAL_CUTOFF, RULE_CONTRACT, TOKEN, WEAK_THRESHOLD
from ..functions.text import let, tokens
from ..runtime import ship
from ..schemas import RULE_COLUMNS

_TOKEN = re.compile(TOKEN)
SEEDS = Path(__file__).resolve().parent.parent / "resources"


@dataclass
class Rules:
    """Validated rules. words and phrases: term to (label, weight, category, reason)."""

    words: dict[str, tuple] = field(default_factory=dict)
    phrases: dict[str, tuple] = field(default_factory=dict)
    negations: dict[str, int] = field(default_factory=dict)
    multipliers: dict[str, float] = field(default_factory=dict)
    intensifiers: frozenset[str] = frozenset()
    blockers: dict[str, int] = field(default_factory=dict)
    contrasts: tuple[tuple[str, str], ...] = ()
    shifting: frozenset[str] = frozenset()
    version: str = "seed"
    max_abs: float = MAX_ABS
    shift: float = NEGATION_SHIFT
    negative_weight: float = NEGATIVE_WEIGHT
    repetition: bool = True

    @classmethod
    def load(cls, words: str | Path | None = None, phrases: str | Path | None = None, modifiers: str | Path | None = None, metadata: str | Path | None = None) -> Rules:
        """From JSON files of the usual shape; the package's own small seed for those not given."""

        def read(path: str | Path | None, name: str) -> dict:
            data = json.loads(Path(path or SEEDS / name).read_text(encoding="utf-8"))
            if not isinstance(data, dict):
                raise ValueError(f"{path or name}: not an object")
            return data

        w, p, m, meta = read(words, "words.json"), read(phrases, "phrases.json"), read(modifiers, "modifiers.json"), read(metadata, "scale.json")
        mods = m.get("modifiers", m)
        return cls.of(
            w.get("word_rules", []), p.get("phrase_rules", []), mods,
            version=";".join(f"{k}={v.get('version', '?')}" for k, v in (("metadata", meta), ("words", w), ("phrases", p), ("modifiers", m))),
            max_abs=float(meta.get("score_scale", {}).get("max_abs", MAX_ABS)) or MAX_ABS, shift=float(meta.get("negation_shift", NEGATION_SHIFT)),
            negative_weight=float(meta.get("negative_weight", NEGATIVE_WEIGHT)), repetition=bool(meta.get("repetition_weighting", True)),
        )

    @classmethod
    def of(cls, words: Sequence[Mapping], phrases: Sequence[Mapping], modifiers: Mapping, **settings) -> Rules:
        """From entries; ValueError for a label outside the domain, a weight outside 0..2, an empty term, a scope or
        multiplier that isn't positive."""

        def entries(items: Sequence[Mapping], key: str) -> dict[str, tuple]:
            out = {}
            for x in items:
                term, label, weight = str(x.get(key, "")).strip().lower(), x.get("label"), x.get("weight")
                if not term or label not in LABELS or not isinstance(weight, (int, float)) or not 0 <= weight <= 2:
                    raise ValueError(f"bad lexicon entry: {dict(x)}")
                out[term] = (label, float(weight), str(x.get("category", "")), str(x.get("reason", "")))
            return out

        def terms(name: str) -> list[Mapping]:
            for x in modifiers.get(name, []):
                if not str(x.get("term", "")).strip() or x.get("scope", 1) <= 0 or x.get("multiplier", 1) <= 0:
                    raise ValueError(f"bad modifier in {name}: {dict(x)}")
            return modifiers.get(name, [])

        contrasts = tuple((str(x["term"]).lower(), str(x.get("effect", ""))) for x in terms("contrast_markers"))
        unknown = {e for _, e in contrasts} - set(CLAUSE_WEIGHTS)
        if unknown:
            raise ValueError(f"unknown effects of contrast markers: {sorted(unknown)}")
        ups = {str(x["term"]).lower(): float(x["multiplier"]) for x in terms("intensifiers")}
        downs = {str(x["term"]).lower(): float(x["multiplier"]) for x in terms("downtoners")}
        return cls(
            words=entries(words, "term"), phrases=entries(phrases, "phrase"), negations={str(x["term"]).lower(): int(x.get("scope", 1)) for x in terms("negations")},
            shifting=frozenset(str(x["term"]).lower() for x in terms("negations") if x.get("effect", "shift") == "shift"), multipliers={**downs, **ups},
            intensifiers=frozenset(ups), blockers={str(x["term"]).lower(): int(x.get("scope", 1)) for x in terms("irrealis_blockers")}, contrasts=contrasts, **settings,
        )


def whole(term: str) -> re.Pattern[str]:
    return re.compile(rf"(?<!\w){re.escape(term)}(?!\w)")


class Engine:
    """Scores one text at a time by compiled rules."""

    def __init__(self, rules: Rules, threshold: float = WEAK_THRESHOLD, cutoff: float = NEUTRAL_CUTOFF):
        self.rules, self.threshold, self.cutoff = rules, threshold, cutoff
        longest_first = sorted(rules.phrases, key=len, reverse=True)
        self.phrases = [(p, whole(p), rules.phrases[p]) for p in longest_first]
        self.marks = [(t, whole(t), CLAUSE_WEIGHTS[e]) for t, e in rules.contrasts]

    def _clauses(self, text: str) -> tuple[list[int], list[float]]:
        """Positions from which a weight holds, ascending; of equal positions the last one counts."""
        at = [(0, 1.0)]
        for term, pattern, (before, after) in self.marks:
            if term in text:
                for m in pattern.finditer(text):
                    if before is not None:
                        at.append((0, before))
                    at.append((m.end(), after))
        at.sort(key=lambda x: x[0])
        return [x[0] for x in at], [x[1] for x in at]

    def _modifiers(self, words: list[str], first: int, last: int) -> tuple[list[str], float, bool]:
        """Terms, product of multipliers, and whether a shifting negation is among them."""
        r, terms, factor, shift = self.rules, [], 1.0, False
        for k in range(first - 1, max(first - 5, -1), -1):
            if first - k <= r.negations.get(words[k], 0):
                terms.append(words[k])
                shift = words[k] in r.shifting
                break
        for k in range(first - 1, max(first - 4, -1), -1):
            if words[k] in r.multipliers:
                terms.append(words[k])
                factor *= r.multipliers[words[k]]
                break
        if last + 1 < len(words) and words[last + 1] in r.multipliers:
            terms.append(words[last + 1])
            factor *= r.multipliers[words[last + 1]]
        return terms, factor, shift

    def _blocker(self, words: list[str], first: int) -> str:
        for k in range(first - 1, max(first - 5, -1), -1):
            if first - k <= self.rules.blockers.get(words[k], 0):
                return words[k]
        return ""

    def _hit(self, term: str, source: str, rule: tuple, span: tuple[int, int], words: list[str], first: int, last: int, clauses) -> dict:
        label, weight, category, reason = rule
        terms, factor, shift = self._modifiers(words, first, last)
        blocked = self._blocker(words, first)
        clause = clauses[1][bisect_right(clauses[0], span[0]) - 1]
        score = {"positif": weight, "negatif": -weight}.get(label, 0.0)
        if blocked:
            score = 0.0
        else:
            score *= factor
            if shift and score:
                score -= self.rules.shift if score > 0 else -self.rules.shift
            score *= clause
            if score < 0:
                score *= self.rules.negative_weight
        shown = "positif" if score > 0 else "negatif" if score < 0 else label
        return {"term": term, "label": shown, "source": source, "score": round(score, 4), "weight": weight, "category": category, "reason": reason,
                "span": list(span), "modifiers": terms, "clause_weight": clause, "repetition_weight": 1.0, "blocked_by": blocked}

    def analyze(self, text: str | None) -> dict:
        """The 17 columns of the rule contract."""
        low = (text or "").lower()
        spots = [m.span() for m in _TOKEN.finditer(low)]
        words = [low[a:b] for a, b in spots]
        starts = [a for a, _ in spots]
        clauses = self._clauses(low)
        taken: list[tuple[int, int]] = []
        phrase_hits, word_hits, neutral = [], [], []
        for term, pattern, rule in self.phrases:
            if term not in low:
                continue
            for m in pattern.finditer(low):
                a, b = m.span()
                if any(a < y and x < b for x, y in taken):
                    continue
                inside = [k for k in range(bisect_right(starts, a - 1), len(spots)) if spots[k][1] <= b]
                if inside:
                    phrase_hits.append(self._hit(term, "phrase", rule, (a, b), words, inside[0], inside[-1], clauses))
                    taken.append((a, b))
        for k, word in enumerate(words):
            rule = self.rules.words.get(word)
            if rule is None or any(x <= spots[k][0] and spots[k][1] <= y for x, y in taken):
                continue
            if rule[0] == "netral":
                neutral.append(word)
            else:
                word_hits.append(self._hit(word, "word", rule, spots[k], words, k, k, clauses))
        hits = phrase_hits + word_hits
        if self.rules.repetition:
            seen: dict[tuple[str, str], int] = {}
            for h in sorted(hits, key=lambda h: h["span"]):
                if h["score"] and not h["modifiers"]:
                    key = (h["source"], h["term"])
                    n = seen[key] = seen.get(key, 0) + 1
                    if n > 1:
                        h["repetition_weight"] = round(1 / n, 4)
                        h["score"] = round(h["score"] * h["repetition_weight"], 4)
        return self._contract(hits, phrase_hits, word_hits, neutral)

    def _contract(self, hits: list[dict], phrase_hits: list[dict], word_hits: list[dict], neutral: list[str]) -> dict:
        plus, minus = [h["score"] for h in hits if h["score"] > 0], [h["score"] for h in hits if h["score"] < 0]
        positive, negative = round(sum(plus), 4), round(abs(sum(minus)), 4)
        score = round(positive - negative, 4)
        confidence = round(min(abs(score) / self.rules.max_abs, 1.0), 4)
        label = "positif" if score > self.cutoff else "negatif" if score < -self.cutoff else "netral"
        status = "unknown" if not plus and not minus else "weak" if confidence < self.threshold else "detected"
        by_phrase, by_word = [h["term"] for h in phrase_hits], [h["term"] for h in word_hits]
        changed = list(dict.fromkeys(m for h in hits for m in h["modifiers"] if m))
        named = [f"{name}: {', '.join(terms)}" for name, terms in (("frasa", by_phrase), ("kata", by_word), ("modifier", changed)) if terms]
        # The wording of the explanation.
        told = "Tidak ada rule sentimen yang dihitung." if status == "unknown" else (
            f"Label {label} ({status}) dari skor SO {score:.4f}; positif={positive:.4f}, negatif={negative:.4f}; {'; '.join(named) or 'tanpa evidence detail'}."
        )
        values = (RULE_CONTRACT, self.rules.version, label, score, confidence, status, positive, negative, len(plus), len(minus), ", ".join(by_phrase + by_word),
                  ", ".join(neutral), ", ".join(by_phrase), ", ".join(by_word), ", ".join(changed), hits, told)
        return dict(zip((c for c, _ in RULE_COLUMNS), values, strict=True))


def evidence_payload(rules: Rules, reference: str = "") -> Column:
    """The evidence of a scored row as JSON text: method, resource versions and scale of the rules, hits that count and
    neutral words. Works on the columns of score_texts()."""
    versions = F.create_map(*[F.lit(x) for part in rules.version.split(";") for x in (*part.split("=", 1), "")[:2]]) if rules.version else F.create_map().cast("map<string,string>")
    neutral = F.filter(F.split("rule_neutral_hits", ", "), lambda x: x != "")
    return F.to_json(F.struct(
        F.lit("SO-CAL-inspired").alias("method"), F.lit(reference).alias("method_reference"), F.col("rule_resource_version").alias("resource_version"), versions.alias("resource_versions"),
        F.struct(F.lit(rules.max_abs).alias("max_abs")).alias("score_scale"), F.lit(rules.shift).alias("negation_shift"), F.lit(rules.negative_weight).alias("negative_weight"),
        F.lit(rules.repetition).alias("repetition_weighting"), F.col("rule_evidence").alias("sentiment_hits"), neutral.alias("neutral_hits"),
    ))


def score_texts(df: DataFrame, text: str, rules: Rules | None = None, threshold: float = WEAK_THRESHOLD) -> DataFrame:
    """df with the 17 rule columns. Evidence stays an array of structs; to_json() makes it text at the edge."""

    ship(df.sparkSession)
    own = rules or Rules.load()
    shape = "struct<" + ",".join(f"{n}:{t}" for n, t in RULE_COLUMNS) + ">"

    @F.pandas_udf(shape)
    def analyze(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        engine = Engine(own, threshold)
        names = [c for c, _ in RULE_COLUMNS]
        for texts in batches:
            yield pd.DataFrame([engine.analyze(t) for t in texts], columns=names)

    return df.withColumn("_rule", analyze(F.col(text))).select("*", "_rule.*").drop("_rule")


def word_scores(text: Column, words: Mapping[str, tuple[str, float]], negative_weight: float = NEGATIVE_WEIGHT, max_abs: float = MAX_ABS, threshold: float = WEAK_THRESHOLD) -> Column:
    """struct(score, confidence, label, status, hits) by words alone, with repetition discount: the n-th occurrence of a
    word counts 1/n. Native expressions only. words: word to (label, weight)."""
    return let(tokens(F.coalesce(text, F.lit(""))), lambda t: _scored_words(t, words, negative_weight, max_abs, threshold))


def _scored_words(t: Column, words: Mapping[str, tuple[str, float]], negative_weight: float, max_abs: float, threshold: float) -> Column:
    signs = {"positif": 1.0, "negatif": -negative_weight}
    signed = {w: signs[label] * weight for w, (label, weight) in words.items() if label in signs and weight}
    names, values = F.lit(list(signed)), F.lit(list(signed.values()))
    # lexicon words of the text, equal ones together: the k-th of a word counts 1 / k
    # one hash look-up tells which tokens are words of the lexicon; only those are placed in it
    hits = F.array_sort(F.transform(F.filter(t, lambda x: x.isin(list(signed))), lambda x: F.array_position(names, x).cast("int")))
    start = F.struct(F.lit(0).alias("word"), F.lit(0).alias("k"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"))

    def add(acc: Column, word: Column) -> Column:
        k = F.when(word == acc["word"], acc["k"] + 1).otherwise(1)
        value = F.round(F.element_at(values, word) * F.round(1 / k, 4), 4)
        return F.struct(word.alias("word"), k.alias("k"), (acc["sum"] + value).alias("sum"), (acc["n"] + 1).alias("n"))

    def shown(total: Column) -> Column:
        score = F.round(total["sum"], 4)
        confidence = F.round(F.least(F.abs(score) / max_abs, F.lit(1.0)), 4)
        label = F.when(score > NEUTRAL_CUTOFF, "positif").when(score < -NEUTRAL_CUTOFF, "negatif").otherwise("netral")
        status = F.when(total["n"] == 0, "unknown").when(confidence < threshold, "weak").otherwise("detected")
        return F.struct(score.alias("rule_score"), confidence.alias("rule_confidence"), label.alias("rule_label"), status.alias("rule_status"), total["n"].alias("rule_hits"))

    return F.aggregate(hits, start, add, shown)
