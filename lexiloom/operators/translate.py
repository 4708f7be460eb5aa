"""Rule-based translation of sentences.

The dictionary work is done by joins before: every word comes with its candidates, and
with those of its lemmas. What is left, deciding parts of speech from the neighbours and
putting a sentence into Vietnamese order, is a function of one sentence, in batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from lexiloom.functions.segment import split_sentences
from lexiloom.functions.tables import FUNCTION_WORDS, PAST_FORMS
from lexiloom.operators.gloss import HOT_SENTENCE, Known, with_dictionary  # noqa: F401

NOUN, VERB, ADJ, ADV = "danh từ", "động từ", "tính từ", "phó từ"
ADV_TOO = "trạng từ"
DETERMINERS = {"ARTICLE", "QUANTIFIER", "POSSESSIVE", "DEMONSTRATIVE"}


@dataclass
class Unit:
    """One word, phrase or mark of a sentence on its way."""

    source: str
    role: str = ""  # "", a part of speech, "FUNC", "PUNCT" or "?"
    vi: str = ""
    category: str = ""  # of a function word
    candidates: list[dict] = field(default_factory=list)
    lemmas: list[dict] = field(default_factory=list)  # [{form, via_lemma, candidates}] by rank
    past: bool = False
    gerund: bool = False
    by_lemma: bool = False
    negated: bool = False
    dropped: bool = False

    @property
    def low(self) -> str:
        return self.source.lower()

    def can_be(self, *names: str) -> bool:
        return any(c["pos"] and any(n in c["pos"] for n in names) for c in self.candidates)

    def is_(self, *categories: str) -> bool:
        return self.category in categories and self.role == "FUNC"

    def verb_by_lemma(self) -> bool:
        """Take over the meanings of the first lemma that is a verb."""
        for x in self.lemmas:
            if any(c["pos"] and VERB in c["pos"] for c in x["candidates"]):
                self.candidates = x["candidates"]
                return True
        return False


def is_past(word: str) -> bool:
    w = word.lower()
    return len(w) >= 3 and (w in PAST_FORMS or (w.endswith("ed") and len(w) > 3))


def ends_in_s(word: str) -> bool:
    return len(word) > 3 and word.endswith("s") and not word.endswith("ss")


def alternatives(gloss: str | None) -> list[str]:
    bare = re.sub(r"\[[^\]]*\]", " ", re.sub(r"\([^)]*\)", " ", gloss or ""))
    return [a for a in (" ".join(p.split()) for p in re.split("[,;]", bare)) if a]


@lru_cache(1 << 16)
def short(gloss: str | None) -> str:
    return next(iter(alternatives(gloss)), " ".join((gloss or "").split()))


@lru_cache(1 << 16)
def junk(gloss: str | None) -> bool:
    return not gloss or not gloss.strip() or "<" in gloss or not short(gloss)


def _live(units: list[Unit], i: int, step: int) -> Unit | None:
    j = i + step
    while 0 <= j < len(units):
        if not units[j].dropped:
            return units[j]
        j += step
    return None


def _back(units: list[Unit], i: int, skip: Callable[[Unit], bool]) -> Unit | None:
    return next((u for u in reversed(units[:i]) if not (u.dropped or skip(u))), None)


def verb_before(units: list[Unit], i: int) -> bool:
    u = _back(units, i, lambda x: x.role == "PUNCT" or x.is_("CONJUNCTION"))
    return u is not None and u.role == VERB


def subject_before(units: list[Unit], i: int) -> bool:
    """Whether a noun that a determiner or preposition leads, or nothing, is just before."""
    j = next((k for k in range(i - 1, -1, -1) if not units[k].dropped), None)
    if j is None or units[j].role != NOUN:
        return False
    lead = _back(units, j, lambda x: x.role in (ADJ, ADV))
    return lead is None or lead.is_("PREPOSITION", *DETERMINERS)


def _roles() -> list[tuple[Callable, str, str]]:
    """Rules in order: when, the role, and how a verb's meanings are chosen.

    ``promote``: the word is a verb, or a lemma of it is. ``lemma``: likewise, and where
    the word is a verb itself its lemma's meanings are preferred. ``plain``: as it is.
    """

    def prev_is(*categories: str) -> Callable:
        return lambda us, i, u, p, n: p is not None and p.is_(*categories)

    after_subject = lambda p: p is None or p.role == NOUN or p.is_("PRONOUN")
    content = lambda n: n is not None and n.role != "PUNCT" and not n.category
    listed = lambda us, i, u, p, n: p is not None and (p.role == "PUNCT" or p.is_("CONJUNCTION")) and verb_before(us, i)
    same_adjective = lambda us, i, u, p, n: p is not None and p.is_("CONJUNCTION") and (b := next((x for x in reversed(us[: max(0, i - 1)]) if not x.dropped), None)) is not None and b.role == ADJ
    before_noun = lambda us, i, u, p, n: content(n) and not (p is not None and p.is_("ARTICLE") and ends_in_s(n.source))
    return [
        (lambda us, i, u, p, n: u.low.endswith("ly") and u.can_be(ADV, ADV_TOO), ADV, "plain"),
        (lambda us, i, u, p, n: i == 0, VERB, "promote"),
        (listed, VERB, "lemma"),
        (lambda us, i, u, p, n: u.past and after_subject(p), VERB, "lemma"),
        (lambda us, i, u, p, n: ends_in_s(u.low) and subject_before(us, i), VERB, "promote"),
        (lambda us, i, u, p, n: u.can_be(ADJ) and same_adjective(us, i, u, p, n), ADJ, "plain"),
        (lambda us, i, u, p, n: u.can_be(ADJ) and prev_is("ADVERB")(us, i, u, p, n), ADJ, "plain"),
        (lambda us, i, u, p, n: u.can_be(ADJ) and before_noun(us, i, u, p, n), ADJ, "plain"),
        (prev_is("PRONOUN", "MODAL", "FUTURE", "NEGATION", "DO", "INFINITIVE", "HAVE"), VERB, "promote"),
        (lambda us, i, u, p, n: u.gerund and prev_is("BE")(us, i, u, p, n), VERB, "promote"),
        (lambda us, i, u, p, n: u.can_be(NOUN) and prev_is("PREPOSITION", *DETERMINERS)(us, i, u, p, n), NOUN, "plain"),
        (lambda us, i, u, p, n: u.past, VERB, "lemma"),
        (lambda us, i, u, p, n: u.can_be(NOUN), NOUN, "plain"),
        (lambda us, i, u, p, n: u.can_be(VERB), VERB, "plain"),
        (lambda us, i, u, p, n: u.can_be(ADJ), ADJ, "plain"),
        (lambda us, i, u, p, n: u.can_be(ADV, ADV_TOO), ADV, "plain"),
    ]


ROLES = _roles()


def assign_roles(units: list[Unit]) -> None:
    for i, u in enumerate(units):
        if u.category:
            u.role = "FUNC"
        if u.role in ("PUNCT", "FUNC", VERB):
            continue
        p = units[i - 1] if i else None
        n = units[i + 1] if i + 1 < len(units) else None
        u.role = ""
        is_verb = u.can_be(VERB)
        for when, role, how in ROLES:
            if not when(units, i, u, p, n):
                continue
            if how != "plain" and not is_verb and not u.verb_by_lemma():
                continue
            if how == "lemma" and is_verb:
                u.verb_by_lemma()
            u.role = role
            break
        u.role = u.role or "?"


def pick(u: Unit, prior: dict[str, dict[str, float]], priority: dict[int, int]) -> str:
    """The Vietnamese of a unit: of its role, of the best source, the likeliest."""
    if not u.candidates:
        return u.source
    wanted = u.role if u.role in (NOUN, VERB, ADJ, ADV) else None
    proper = [c for c in u.candidates if not junk(c["gloss"])]
    pool = [c for c in proper if wanted and c["pos"] and wanted in c["pos"]] or proper
    if not pool:
        return short(u.candidates[0]["gloss"])
    rank = lambda c: priority.get(c["source_id"], 2**31 - 1)
    best = min(map(rank, pool))
    pool = [c for c in pool if rank(c) == best]
    chosen, top = None, 0.0

    def likely(en: str, alt: str) -> float:
        toks = re.findall(r"[^\W_]+", alt.lower())
        return sum(prior.get(en, {}).get(t, 0.0) for t in toks) / len(toks) ** 0.5 if toks else 0.0

    if prior:
        for c in pool:
            for alt in alternatives(c["gloss"]):
                score = likely(u.low, alt) or likely(c["headword"] or "", alt)
                if score > top:
                    chosen, top = alt, score
    return chosen or short(pool[0]["gloss"])


def compare_degrees(units: list[Unit]) -> None:
    for u in units:
        if u.role in (ADJ, ADV) and u.vi.strip() and u.by_lemma:
            if u.low.endswith("est") and len(u.low) > 5:
                u.vi += " nhất"
            elif u.low.endswith("er") and len(u.low) > 4:
                u.vi += " hơn"


def merge_words(units: list[Unit]) -> None:
    """Degree adverbs into adjectives, negations into auxiliaries, auxiliaries, tense."""
    for i, u in enumerate(units):
        n = _live(units, i, 1)
        if not u.dropped and u.is_("ADVERB") and n is not None and n.role == ADJ:
            n.vi, u.dropped = f"{u.vi} {n.vi}", True
    for i, u in enumerate(units):
        p = _live(units, i, -1)
        if i == 0 or not u.is_("NEGATION") or p is None or not p.category:
            continue
        if p.category == "MODAL":
            p.vi = "không thể" if p.vi == "có thể" else f"không {p.vi}"
        elif p.category == "FUTURE":
            p.vi += " không"
        elif p.category in ("BE", "DO", "HAVE"):
            p.vi, p.negated = "chưa" if p.category == "HAVE" else "không", True
        else:
            continue
        u.dropped = True
    for i, u in enumerate(units):
        n = _live(units, i, 1)
        if not u.dropped and (u.negated or u.is_("NEGATION")) and n is not None and n.vi.startswith("rất "):
            n.vi = n.vi[4:] + " lắm"
    for i, u in enumerate(units):
        n = _live(units, i, 1)
        if u.dropped or n is None or u.negated:
            continue
        if u.is_("BE"):
            if n.role == VERB and n.gerund:
                u.vi = "đang"
            elif n.role == ADJ:
                u.dropped = True
        elif n.role == VERB and (u.is_("DO") or (u.is_("PREPOSITION") and u.low == "to")):
            u.dropped = True
    for i, u in enumerate(units):
        p = _live(units, i, -1)
        if not u.dropped and u.role == VERB and u.past and not (p is not None and p.is_("HAVE", "FUTURE", "MODAL", "BE", "NEGATION")):
            u.vi = f"đã {u.vi}"


#: Places within a Vietnamese noun phrase; nouns are what no other kind claims.
_PLACES = ("ARTICLE", "QUANTIFIER", NOUN, ADJ, "DEMONSTRATIVE", "POSSESSIVE")


def reorder(units: list[Unit]) -> list[Unit]:
    """Each noun phrase in the order quantifier, nouns, adjectives, this, mine."""

    def belongs(u: Unit) -> bool:
        return not u.dropped and (u.role in (NOUN, ADJ) or u.is_(*DETERMINERS))

    def kind(u: Unit) -> int:
        name = u.category if u.is_(*DETERMINERS) else ADJ if u.role == ADJ else NOUN
        return _PLACES.index(name)

    out, i = list(units), 0
    while i < len(out):
        j, last = i, -1
        while j < len(out) and belongs(out[j]) and not (last >= 0 and out[j].is_(*DETERMINERS)):
            last = j if out[j].role == NOUN else last
            j += 1
        if last <= i:
            i = max(j, i + 1)
            continue
        span = sorted(out[i : last + 1], key=kind)  # stable
        for u in span:
            u.dropped = u.dropped or u.is_("ARTICLE")
        out[i : last + 1] = span
        i = last + 1
    return out


def joined(units: list[Unit]) -> str:
    text = ""
    for u in units:
        piece = u.vi.strip()
        if not u.dropped and piece:
            text += piece if u.role == "PUNCT" or not text else f" {piece}"
    text = " ".join(text.split())
    return text[:1].upper() + text[1:]


def translate(segments: list[dict], lemmas: dict[str, list[dict]], prior: dict[str, dict[str, float]] | None = None, priority: dict[int, int] | None = None) -> str:
    """One sentence from its segments; ``lemmas`` holds each word's resolved lemmas."""
    units = []
    for s in segments:
        if s["kind"] == "PUNCT":
            if s["source"].strip():
                units.append(Unit(s["source"].strip(), "PUNCT", s["source"].strip()))
            continue
        first = s["source"].split()[0]
        fixed = FUNCTION_WORDS.get(s["source"].lower())
        known = lemmas.get(s["source"].lower(), [])
        u = Unit(s["source"], candidates=list(s["candidates"]), lemmas=[x for x in known if x["rank"] > 0], past=is_past(first), gerund=first.lower().endswith("ing"))
        u.category = fixed[1] if fixed else ""
        u.by_lemma = any(x["rank"] == 0 and x["via_lemma"] for x in known)
        if s["kind"] == "PHRASE":
            # the dictionary's word on a phrase stands if it is a verb
            u.role = VERB if u.can_be(VERB) or not u.can_be(NOUN) else ""
        units.append(u)
    assign_roles(units)
    for u in units:
        if u.role != "PUNCT":
            u.vi = FUNCTION_WORDS[u.low][0] if u.category else pick(u, prior or {}, priority or {})
    compare_degrees(units)
    merge_words(units)
    return joined(reorder(units))


def translate_texts(texts: DataFrame, entries: DataFrame, sources: DataFrame | None = None, lexicon: DataFrame | None = None) -> DataFrame:
    """``(text_id, translation)`` of ``texts`` = ``(text_id, text)``.

    Sentences are translated one by one and joined by a space. Null and empty texts give
    an empty translation. Equal sentences of a chunk of texts are translated once.
    """
    order = {r["id"]: r["priority"] for r in sources.select("id", "priority").collect()} if sources is not None else {}

    def make(rows: pa.Table, known: Known) -> pa.Table:
        prior = {w: {x["f"]: x["p"] for x in xs} for w, xs in known.priors.items()}
        done: dict[str, str] = {}

        def say(sentence: str) -> str:
            if sentence not in done:
                segments = known.segments(sentence)
                words = {known.low[s["source"]] for s in segments if s["kind"] in ("WORD", "UNKNOWN")}
                lemmas = {w: xs for w in words if (xs := known.resolved(w))}
                done[sentence] = translate(segments, lemmas, {w: prior[w] for w in lemmas if w in prior}, order)
            return done[sentence]

        said = [" ".join(map(say, split_sentences(t))) for t in rows["text"].to_pylist()]
        return pa.table({"text_id": rows["id"], "translation": pa.array(said, pa.string())})

    return with_dictionary(texts, "text_id", "text", entries, sources, None, make=make, schema=f"text_id {dict(texts.dtypes)['text_id']}, translation string", cut=split_sentences, lemmas=True, priors=lexicon)
