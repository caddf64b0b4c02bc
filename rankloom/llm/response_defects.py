"""Broken prompt and response pairs: noisy labelling functions combined by a label model.

Each defect has its own labelling functions. A function looks at one pair and fires or doesn't; some fire for the
defect, some against it, none is trusted. For each defect the pattern of firing functions is counted over all pairs (an
aggregate of at most 2^m rows for m functions), and expectation-maximization fits a two-class model to the counts: how
frequent the defect is, and how often every function fires with and without it. The posterior of a pair's pattern is
its score. A pair keeps every defect whose posterior passes the defect's cutoff; the cutoffs are validated on labelled
pairs in the tests.

Defined results: null, blank and shell answers are ``empty`` and nothing else; a null prompt asks for nothing, so no
``copy`` and no ``language``; pairs repeated in the log are judged row by row; other columns are ignored.
"""

from __future__ import annotations

import difflib
import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.plans.session import checkpoint

DEFECTS = ("empty", "copy", "refusal", "truncated", "language")
#: Posterior a defect has to reach, validated on labelled pairs.
CUTOFFS = {"empty": 0.5, "copy": 0.5, "refusal": 0.5, "truncated": 0.5, "language": 0.5}

# Function words by language, names of languages in requests, and turns of phrase of refusals.
STOP = {
    "en": "the of and in with for to on by from that as at this every each our no when while despite across beside within under not its does one some is are what".split(),
    "de": "die der das und mit für von den dem bei nach über ein eine einer eines zum zur im trotz neben vor ist nicht durch unter zwischen ohne sich".split(),
    "fr": "les des le la et dans sur avec pour une un de du selon entre parmi contre malgré pendant sont est qui que ne pas par après".split(),
    "es": "las los el la y en con para una un de del entre según contra hacia sobre durante ante por desde sin no es son tras".split(),
}
ASKED = {
    "en": r"answer in english|in english please|auf englisch|en anglais|en inglés",
    "de": r"in german|antworte auf deutsch|en allemand|en alemán",
    "fr": r"in french|auf französisch|réponds en français|en francés",
    "es": r"in spanish|auf spanisch|en espagnol|responde en español",
}
CANNOT = re.compile(
    r"\b(?:can'?t|cannot|can not|unable|not able|won'?t be able|could not|must decline|decline|refuse|not comfortable|not feel comfortable|(?:i'?d|would) rather not|off the table|not allowed|(?:am|is) allowed|not something i|no list will|outside (?:of )?(?:what|my)|leave (?:it|to)|closed this|improper|on which i|say nothing|stay silent|go against"
    r"|kann ich|ich kann|darf ich|muss ich|ablehnen|nicht helfen|gebe ich|treffe ich|lasse ich|nicht in meinen|unbeantwortet|keine auskunft|verweiger\w+|möchte ich nicht"
    r"|je ne peux|impossible de|je préfère ne|ne viendra|autorisé à|je laisse|je refuse|je dois décliner|ne souhaite pas|hors de mon|sans réponse"
    r"|no puedo|rechazar|no voy a|lo dejo|no me es posible|no estoy autorizad\w+|prefiero no|fuera de mi|(?:no )?tengo (?:permitido|prohibido)|no me está permitido|m'est fermé|il m'est|no me corresponde|no saldrá de mí|no me permite\w*)\b", re.I)  # fmt: skip
POLITE = re.compile(
    r"\b(?:i'?m sorry|sorry,|unfortunately|regrettably|as an? (?:ai|language model)|guidelines|usage policy|operators|remit|librarian|specialist|ask something else|consult|feel free"
    r"|tut mir leid|leider|sprachmodell|vorgaben|fachperson|bibliothek|wenden sie sich|aufgabenbereich"
    r"|désolé|hélas|malheureusement|bibliothécaire|bibliothèque|adressez-vous|mes règles|modèle de langue|voyez"
    r"|lo siento|lamento|normas|bibliotecari[oa]|biblioteca|modelo de lenguaje|consulte|pregunte|acuda)\b", re.I)  # fmt: skip
SELF = re.compile(r"\b(?:i|i'm|i'd|my|me|ich|mir|mich|mein|meine[nrms]?|je|j|moi|mes|mon|ma|yo|mis?|me)\b", re.I)
ITEM = re.compile(r"^\s*(?:[-*•–]|\d+[.)]|\[\d+\]|\(\d+\))\s+\S", re.M)
LENGTH = {"length", "max_tokens", "token_limit", "max_output_tokens"}

#: Function -> its starting rates of firing with and without the defect. Those that start lower with it speak against it.
FUNCTIONS: dict[str, dict[str, tuple[float, float]]] = {
    "empty": {"no_text": (0.6, 0.001), "no_letter": (0.8, 0.002), "shell": (0.8, 0.002), "long": (0.01, 0.95)},
    "copy": {"same": (0.6, 0.001), "within": (0.7, 0.005), "nothing_new": (0.8, 0.005), "answer": (0.02, 0.9)},
    "refusal": {"cannot": (0.7, 0.02), "polite": (0.5, 0.005), "self": (0.7, 0.04), "filter": (0.3, 0.01), "bare": (0.9, 0.05), "answer": (0.03, 0.9)},
    "truncated": {"open_end": (0.95, 0.002), "unbalanced": (0.3, 0.005), "last_item": (0.3, 0.01), "cut_json": (0.4, 0.005), "limit": (0.4, 0.04)},
    "language": {"other": (0.9, 0.01), "far": (0.85, 0.01), "none_asked": (0.8, 0.05), "letters": (0.4, 0.02)},
}

#: A defect needs one of these functions; the others only add to or take from what they say. Without anchors the two
#: classes of the model could settle on any other split of the pairs, such as short and long answers.
ANCHORS = {
    "empty": {"no_text", "no_letter", "shell"}, "copy": {"same", "within", "nothing_new"}, "refusal": {"cannot", "polite", "self", "filter"},
    "truncated": {"open_end", "unbalanced", "last_item", "cut_json"}, "language": {"other", "far"},
}


def letters_only(text: str) -> str:
    return " ".join(re.findall(r"\w+", text.lower()))


def body(text: str) -> str:
    """The answer without code fence and without a leading line that only announces it."""
    text = text.strip()
    lead = re.match(r"[^\n]{0,160}:\s*\n(?=\S)", text)
    return re.sub(r"^\s*```\w*\s*|\s*```\s*$", "", text[lead.end() :] if lead else text)


def prose(text: str) -> str:
    """What an answer says in its own words: the prose fields of JSON (not titles), else everything."""
    if '"' in text and re.match(r"\s*[{\[]", text):
        said = re.findall(r'"(?:rationale|note|summary|reason|comment|answer|text)"\s*:\s*"((?:[^"\\]|\\.)*)', text)
        return " ".join(said)
    return text


def shares(text: str) -> dict[str, int]:
    words = re.findall(r"[^\W\d_]+", text.lower())
    return {k: sum(w in s for w in words) for k, s in _STOP.items()}


_STOP = {k: frozenset(v) for k, v in STOP.items()}
_LETTERS = {"de": "äöüß", "fr": "éèêàçùîôœ", "es": "áéíóúñ¿¡"}


def asked_language(prompt: str) -> str | None:
    low = prompt.lower()
    for code, words in ASKED.items():
        if re.search(words, low):
            return code
    found = shares(low)
    best = max(found.values())
    lead = [k for k in found if found[k] == best]
    if best and len(lead) == 1:
        return lead[0]
    signs = {k: sum(low.count(c) for c in v) for k, v in _LETTERS.items()}
    return max(lead, key=lambda k: signs.get(k, 0)) if best else None


def fired(prompt: str | None, answer: str | None, reason: str | None) -> dict[str, set[str]]:
    """The functions that fire for a pair, by defect."""
    prompt, answer = prompt or "", answer or ""
    out: dict[str, set[str]] = {d: set() for d in DEFECTS}
    stripped = re.sub(r"[\s​-‏⁠﻿\xa0]+", " ", answer).strip()
    inner = body(answer)
    # empty
    bare = re.sub(r'"articles"|"results"|"items"|null|none|n/a|json', "", stripped, flags=re.I)
    if not stripped:
        out["empty"].add("no_text")
    if not re.search(r"\w", stripped):
        out["empty"].add("no_letter")
    if not re.search(r"\w", bare) and len(stripped) < 60:
        out["empty"].add("shell")
    if len(stripped) > 30:
        out["empty"].add("long")
    if not re.search(r"\w", bare):
        return out
    reason = (reason or "").lower()
    items = len(ITEM.findall(inner)) + inner.count('"title"')
    # copy
    said = re.sub(r'^\s*\{?\s*"articles":\s*\[\s*\{\s*"title":\s*|^\s*(?:you asked|sie fragten|ihre frage|votre question|vous avez demandé|usted preguntó|su pregunta|question|frage|pregunta|prompt)\s*:\s*', "", stripped, flags=re.I)
    q, a = letters_only(prompt), letters_only(re.sub(r'"(?:articles|title|prompt|query|note|answer)"\s*:', " ", said))
    words = a.split()
    new = [w for w in words if w not in set(q.split())]
    near = difflib.SequenceMatcher(None, a, q, autojunk=False).ratio() if q and 0.3 * len(q) < len(a) < 1.6 * len(q) and len(a) < 600 else 0.0
    rest = a.replace(q, " ") if len(q) > 8 else a  # the prompt may come several times
    again = rest != a and len(rest.split()) <= 2
    if q and (near > 0.9 or again):
        out["copy"].add("same")
    if q and (again or a in q or near > 0.8 or (q in a and len(a) < len(q) + 40)):
        out["copy"].add("within")
    if q and words and len(words) <= 2.5 * len(q.split()) + 8 and len(new) <= max(0 if len(words) < 6 else 1, len(words) // 8):
        out["copy"].add("nothing_new")
    if items > 1 or len(new) > 8:
        out["copy"].add("answer")
    # refusal
    plain = inner.replace("’", "'")
    listed = items > 0 or re.search(r"\(\d{4}\)", inner)
    if CANNOT.search(plain):
        out["refusal"].add("cannot")
    if POLITE.search(plain):
        out["refusal"].add("polite")
    if SELF.search(plain):
        out["refusal"].add("self")
    if reason in ("content_filter", "safety", "refusal"):
        out["refusal"].add("filter")
    if not listed and len(words) < 45 and not out["copy"] & {"same", "within"}:
        out["refusal"].add("bare")
    if listed or len(re.findall(r"[.!?](?:\s|$)", inner)) > 3:
        out["refusal"].add("answer")
    # truncated
    end = answer.rstrip(" \t\r\n`​\xa0")
    is_json = bool(re.match(r"\s*[{\[]\s*[\"{\[]", inner))
    lines = [x for x in inner.split("\n") if x.strip()]
    is_list = not is_json and len(ITEM.findall(inner)) >= 1 and len(ITEM.findall(inner)) >= len(lines) - 1
    if is_json:
        whole = _parses(inner)
        if not whole:
            out["truncated"] |= {"cut_json", "open_end"}
    elif is_list:
        dated = [bool(re.search(r"\(\d{4}\)\W*$", x)) for x in lines]
        if not dated[-1] and (len(lines) == 1 or sum(dated[:-1]) > 0.5 * len(dated[:-1])):
            out["truncated"] |= {"last_item", "open_end"}
    elif not re.search(r"[.!?…。][\"'”»)\]*_]*$|[;:]\)$", end):
        out["truncated"].add("open_end")
    if any(inner.count(x) > inner.count(y) for x, y in ("()", "[]", "{}", "“”", "«»")) or is_json and inner.count('"') % 2:
        out["truncated"].add("unbalanced")
    if reason in LENGTH:
        out["truncated"].add("limit")
    # language
    wanted = asked_language(prompt)
    text = prose(inner)
    found = shares(text)
    total = len(re.findall(r"[^\W\d_]+", text))
    if wanted and total >= 5:
        best = max(found, key=lambda k: (found[k], k == wanted))
        if best != wanted and found[best] >= 2:
            out["language"].add("other")
        if best != wanted and found[best] >= 3 and found[best] >= 2 * max(1, found[wanted]):
            out["language"].add("far")
        if found[wanted] < 0.04 * total:
            out["language"].add("none_asked")
        if wanted == "en" and re.search("[äöüßéèêàçùñáíóú]", re.sub(r"\b[A-ZÄÖÜÉÈÀÇÑÁÍÓÚ]\w+", "", text)) or best != wanted and any(c in _LETTERS.get(best, "") for c in text.lower()):
            out["language"].add("letters")
    return out


def _parses(text: str) -> bool:
    text = text.strip()
    try:
        json.loads(text)
        return True
    except ValueError:
        pass
    try:  # text behind the object does not cut it off
        json.JSONDecoder().raw_decode(text)
        return True
    except ValueError:
        return False


def mask(defect: str, names: set[str]) -> int:
    return sum(1 << k for k, f in enumerate(FUNCTIONS[defect]) if f in names)


def fit(defect: str, counts: dict[int, int], rounds: int = 200, weight: float = 0.1) -> dict[int, float]:
    """Posterior of the defect for every pattern (bits: firing functions) by expectation-maximization.

    The starting rates also act as a prior worth ``weight`` of the pairs, so functions that never fire keep them.
    """
    if not counts:
        return {}
    names = list(FUNCTIONS[defect])
    anchored = mask(defect, ANCHORS[defect])
    start = [FUNCTIONS[defect][f] for f in names]
    total = sum(counts.values())
    share, rates = 0.03, [list(s) for s in start]
    posterior: dict[int, float] = {}
    for _ in range(rounds):
        was = dict(posterior)
        for p in counts:
            odds = math.log(share / (1 - share))
            for k, (w, wo) in enumerate(rates):
                odds += math.log(w / wo) if p >> k & 1 else math.log((1 - w) / (1 - wo))
            posterior[p] = 1 / (1 + math.exp(-max(-60.0, min(60.0, odds)))) if p & anchored else 0.0
        positive = sum(n * posterior[p] for p, n in counts.items())
        prior = weight * total
        share = min(0.5, max(1e-5, (positive + 0.03 * prior) / (total + prior)))
        for k in range(len(names)):
            hit = sum(n * posterior[p] for p, n in counts.items() if p >> k & 1)
            miss = sum(n * (1 - posterior[p]) for p, n in counts.items() if p >> k & 1)
            lone = 0.03 * prior
            rates[k][0] = min(0.999, max(0.001, (hit + lone * start[k][0]) / (positive + lone)))
            rates[k][1] = min(0.999, max(0.0005, (miss + prior * start[k][1]) / (total - positive + prior)))
        if was and max(abs(was[p] - posterior[p]) for p in posterior) < 1e-7:
            break
    return posterior


def judge(df: DataFrame, row_id: str = "resp_id", prompt: str = "prompt_text", answer: str = "output_text", reason: str = "finish_reason") -> DataFrame:
    """(row_id, defect_type, posterior) for every defect of every pair that passes its cutoff."""
    names = [f"m_{d}" for d in DEFECTS]

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks: list[list[int]] = [[] for _ in DEFECTS]
            for p, a, r in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                f = fired(p, a, r)
                for k, d in enumerate(DEFECTS):
                    masks[k].append(mask(d, f[d]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(m, pa.int32()) for m in masks]], names=["row_id", *names])

    pairs = df.select(F.col(row_id).cast("long").alias("row_id"), F.col(prompt).alias("p"), F.col(answer).alias("a"), F.col(reason).alias("r"))
    votes = checkpoint(pairs.mapInArrow(vote, "row_id long, " + ", ".join(f"{n} int" for n in names)))
    seen = votes.select(F.explode(F.array(*[F.struct(F.lit(d).alias("defect"), F.col(n).alias("pattern")) for d, n in zip(DEFECTS, names)])).alias("x")).groupBy("x").agg(F.count("*").alias("n")).collect()
    scores = []
    for d, n in zip(DEFECTS, names):
        posterior = fit(d, {r["x"]["pattern"]: r["n"] for r in seen if r["x"]["defect"] == d})
        kept = {p: s for p, s in posterior.items() if s >= CUTOFFS[d]}
        lookup = F.create_map(*[F.lit(x) for pair in kept.items() for x in pair]) if kept else F.lit(None).cast("map<int,double>")
        scores.append(F.struct(F.lit(d).alias("defect_type"), F.try_element_at(lookup, F.col(n)).alias("posterior")))
    found = votes.select("row_id", F.explode(F.array(*scores)).alias("x")).where("x.posterior is not null")
    return found.select("row_id", "x.defect_type", "x.posterior")


def one_each(judged: DataFrame) -> DataFrame:
    """One defect for each pair: the first of DEFECTS among those kept, an order in which earlier ones explain later ones."""
    order = F.array_position(F.array(*map(F.lit, DEFECTS)), F.col("defect_type"))
    return judged.groupBy("row_id").agg(F.min_by("defect_type", order).alias("defect_type"))
