"""Defective question-answer pairs (problem 2).

Method: question and answer are aligned by shingle containment and by their
longest common subsequence to find copies; sentences of an answer are aligned
with refusal templates to find refusals: a template is a sequence of phrase
classes, and its score in a sentence is the share of its classes that stand there
in order, less what the gaps between them cost.  Truncation uses the completeness
automaton of ``truncation``, language the function words of ``language``.
Each pair is judged on its own in one Arrow pass; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lorequarry.llm.language import language, requested_language
from lorequarry.llm.truncation import ends_sentence, examine

#: What stands for no value, reduced to lower-case letters and digits.
NO_VALUE = frozenset(
    "na nan none null nil void undefined empty blank missing tbd todo notavailable notapplicable noanswer noresponse nodata "
    "novalue keine keineantwort keineangabe leer nichts aucun aucune aucunereponse neant vide ninguno ninguna vacio nada "
    "sinrespuesta 无 暂无 空 没有 无内容 无回答 无答案 未提供 不适用 placeholder xxx".split()
)
#: Phrase classes of each language.
PHRASES = {
    "en": {
        "CANNOT": r"can(?:no|')?t|can ?not|could(?: not|n't)|unable to|not able to|won't|will not|would rather not|not (?:possible|permitted|allowed) to|decline to|refuse to|(?:must|have to) decline",
        "SAY": r"\b(?:answer|help|assist|respond|reply|comment|say|tell|discuss|provide|share|determine|give|offer|support|address)",
        "NOT": r"\b(?:does|do|did) not\b",
        "HOLD": r"\b(?:allow|permit|support|contain|include|provide|cover|mention|give)",
        "ANSWER": r"\b(?:answer|information|details?|enough|anything)",
        "NO": r"\bno\b",
        "NOTHING": r"\bnothing\b",
        "SOURCE": r"\b(?:information|answers?|context|passages?|evidence|data|documents?|results?|notes|sources?|material)\b",
        "TOPIC": r"\b(?:in|about|on) (?:the |this |these |my )?(?:context|passages?|material|documents?|sources|notes|question|topic|this)\b",
        "FOUND": r"\b(?:found|available|given|retrieved|provided|exists?|possible)",
        "IS": r"\b(?:found|have|is|was|are)\b",
        "LITTLE": r"\b(?:not enough|insufficient)\b",
        "IGNORE": r"\bi (?:do not|don't) (?:know|have)\b",
        "OUTSIDE": r"\b(?:outside|beyond)\b",
        "SCOPE": r"\b(?:scope|what i can|my)",
        "DECLINE": r"\bi must decline\b",
    },
    "zh": {
        "CANNOT": r"无法|不能|没办法|没法|无从|难以|不便|不方便|不予|恕不|恕难|拒绝|暂不|暂时不",
        "SAY": r"回答|作答|答复|解答|提供|给出|讨论|判断|确定|处理|评论|透露|协助|帮助|回应|说明|奉告",
        "WITHOUT": r"给不出|没有|找不到|未找到|未能找到|得不出",
        "RESULT": r"答案|相关内容|相关信息|相关资料|结论|依据",
        "SOURCE": r"资料|信息|片段|内容|证据|上下文",
        "LITTLE": r"(?:不足|不够|有限)(?!.*(?:但|不过))",
        "UNRELATED": r"(?:与|和)(?:这个|该|您的)?问题无关",
        "OUTSIDE": r"超出",
        "SCOPE": r"范围|能力",
        "IGNORE": r"我不(?:知道|清楚|了解)|无可奉告|恕不回答",
    },
    "de": {
        "CAN": r"\b(?:kann|können|könnte|darf|möchte|will|werde)\b",
        "NOT": r"\b(?:nicht|nichts|keine)\b",
        "SAY": r"\b(?:sagen|antworten|beantworten|helfen|geben|äußern|beurteilen|mitteilen|beantwortet)\b",
        "ANSWER": r"\b(?:beantworten|beantwortet|antworten|helfen|sagen|äußern|antwort)\b",
        "LITTLE": r"\b(?:keine|nicht genug|zu wenig|unzureichende)\b",
        "SOURCE": r"\b(?:angaben|informationen|unterlagen|antwort|daten)",
        "MUST": r"\b(?:muss|müssen)\b",
        "DECLINE": r"\b(?:ablehnen|passen)",
        "IGNORE": r"\bweiß (?:ich )?(?:es )?nicht\b",
        "ALLOW": r"\b(?:lassen|lässt|erlauben|erlaubt)\b",
        "NONE": r"\bkeine antwort",
    },
    "fr": {
        "CANNOT": r"\b(?:ne (?:peux|puis|peut|pouvons|saurais|souhaite)|n'est pas possible|impossible de|incapable de|refuse de|dois refuser|dois décliner)\b",
        "SAY": r"\b(?:répond|aid|dire|fournir|donner|commenter|comment|pas|discuter)",
        "HOLD": r"\b(?:ne|n')\s?(?:contient|contiennent|permet|permettent|fournit|donne|trouve)\w*\b",
        "ANSWER": r"\b(?:réponse|répondre|information|rien)",
        "LITTLE": r"\b(?:aucune|pas de|pas assez d|insuffisan)\w*\b",
        "SOURCE": r"\b(?:réponse|information|élément|contexte|passage)",
        "IGNORE": r"\bje ne sais pas\b",
    },
    "es": {
        "CANNOT": r"\bno (?:puedo|podemos|puede|es posible|me es posible|soy capaz de|quiero|debo)\b",
        "SAY": r"\b(?:respond|contest|ayud|decir|ofrecer|dar|coment|proporcion|hablar)",
        "HOLD": r"\bno (?:contiene|contienen|permite|permiten|hay|existe|encuentro|se encontr)\w*\b",
        "ANSWER": r"\b(?:respuesta|responder|información|datos|nada)",
        "LITTLE": r"\b(?:información|datos|contexto) insuficiente",
        "IGNORE": r"\bno (?:lo )?sé\b",
        "DECLINE": r"\b(?:debo|tengo que) (?:declinar|rechazar)",
    },
}
#: Refusal templates, and the characters a gap between two of their classes may have.
REFUSALS = {
    "en": (60, "CANNOT SAY", "NOT HOLD ANSWER", "NO SOURCE FOUND", "IS NO SOURCE", "NOTHING TOPIC", "LITTLE SOURCE", "IGNORE", "OUTSIDE SCOPE", "DECLINE"),
    "zh": (14, "CANNOT SAY", "WITHOUT RESULT", "SOURCE LITTLE", "UNRELATED", "OUTSIDE SCOPE", "IGNORE"),
    "de": (60, "CAN NOT SAY", "NOT ANSWER", "LITTLE SOURCE", "MUST DECLINE", "IGNORE", "ALLOW NONE"),
    "fr": (60, "CANNOT SAY", "HOLD ANSWER", "LITTLE SOURCE", "IGNORE"),
    "es": (60, "CANNOT SAY", "HOLD ANSWER", "LITTLE", "IGNORE", "DECLINE"),
}
#: A sentence declines from this score on; a gap of full length costs half a class.
REFUSAL_SCORE, GAP_COST = 0.75, 0.5
#: How a sentence that only comes along with a refusal begins or what it holds.
_POLITE = re.compile(
    r"^\W*(?:thank|thanks|sorry|unfortunately|apolog|as an? (?:ai|assistant|language)|i(?:'m| am) (?:sorry|afraid)|i apologi|danke|vielen dank|leider|entschuldig|es tut mir|tut mir|"
    r"merci|désolé|malheureusement|je suis désolé|gracias|lo siento|lamentablemente|disculp|perd[óo]n|抱歉|很抱歉|对不起|不好意思|很遗憾|遗憾|感谢|谢谢|您好|你好|如有|如需|若需)"
    r"|\b(?:please|bitte|por favor|veuillez|s'il (?:vous|te) plaît|try again|rephrase|feel free|let me know)\b|请(?!求)",
    re.IGNORECASE,
)
#: Words after which a declining sentence goes on to answer.
_CAVEAT = re.compile(r"\b(?:but|however|still|though|aber|jedoch|dennoch|sicher ist|mais|cependant|toutefois|pero|sin embargo|no obstante)\b.*\S|[:：]\s*\S|(?:但|不过|然而|可以确认)", re.IGNORECASE | re.DOTALL)
_AFFIRM = frozenset("yes no ja nein oui non sí si 是 否 不 对 会 能".split())

_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n+")
_CITATION = re.compile(r"(?<!\s)(?:\s*(?:\[\d+(?:\s*[,，]\s*\d+)*\]|【\d+】|\(\d{1,2}\)))+(?=\s*[.。!?！？]?\s*$)")
_TOKEN = re.compile(r"[㐀-鿿぀-ヿ가-힯]|[^\W_㐀-鿿぀-ヿ가-힯]+(?:_[^\W_㐀-鿿぀-ヿ가-힯]+)*")
_PLAIN_VALUE = re.compile(r"\W{0,3}(?:`[^`\n]+`|[\w./:-]+(?:\([^()\n]*\))?)(?:\s*[:=]\s*`?[\w./:-]+`?)?\W{0,2}")
_CODE_END = re.compile(r"(?:^|[.!?。！？:：]\s*)(?:`[^`\n]+`[\s,，、]*)+$")
#: Words no answer ends with; in lower case only, as values such as AND are names.
_OPEN_END = re.compile(
    r"(?<![\w'’-])(?:the|and|or|of|with|from|because|is|are|was|were|its|their|than|der|das|dem|ein|eine|einen|und|oder|mit|von|weil|ist|sind|"
    r"une|avec|sont|parce que|los|una|del|con|porque)[ \t]*$|(?:因为|以及|并且|或者)$"
)
_NO_LETTER = re.compile(r"[\W_]+")
_INVISIBLE = re.compile(r"[\s\x00-\x20­​-‏⁠-⁤﻿　]+")


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    places: dict[str, int] = {}
    for i, t in enumerate(a):
        places[t] = places.get(t, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for t in b:
        m = places.get(t, 0)
        u = v & m
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def containment(a: list[str], b: list[str], width: int = 3) -> float:
    """Share of the shingles of ``a`` that ``b`` holds."""
    width = min(width, len(a), len(b))
    if not width:
        return 0.0
    own = {tuple(a[i : i + width]) for i in range(len(a) - width + 1)}
    return len(own & {tuple(b[i : i + width]) for i in range(len(b) - width + 1)}) / len(own)


def covered(a: list[str], b: list[str], width: int = 3) -> list[int]:
    """Places in ``a`` that lie in a shingle it shares with ``b``."""
    width = min(width, len(a), len(b))
    known = {tuple(b[i : i + width]) for i in range(len(b) - width + 1)}
    found: set[int] = set()
    for i in range(len(a) - width + 1):
        if tuple(a[i : i + width]) in known:
            found.update(range(i, i + width))
    return sorted(found)


def is_copy(question: str, answer: str) -> bool:
    """Whether the answer says nothing but the question again.

    It may be repeated, reordered or slightly edited, and a few words may lead it
    in; words after it are an answer.
    """
    q, a = tokens(question), tokens(answer)
    if len(q) < 2 or not a or containment(q, a) < 0.5 or common_subsequence(q, a) * 2 < len(q):
        return False
    places = covered(a, q)
    if not places or places[-1] < len(a) - 1:
        return False
    lead, between = places[0], places[-1] - places[0] + 1 - len(places)
    return lead <= 6 and between <= max(2, len(q) // 5) and (not lead or a[0] not in _AFFIRM)


def without_question(question: str, answer: str) -> str:
    """The answer without a repetition of the question before it."""
    start = answer.lstrip()
    bare = question.strip()
    if bare and start.lower().startswith(bare.lower()) and len(start) > len(bare):
        return start[len(bare) :].lstrip(" \t\r\n\"”’»」'")
    return answer


_PHRASES = {lang: {name: re.compile(p, re.IGNORECASE) for name, p in classes.items()} for lang, classes in PHRASES.items()}
_TEMPLATES = {lang: (gap, [t.split() for t in templates]) for lang, (gap, *templates) in REFUSALS.items()}
#: A sentence without a phrase that a template needs cannot reach the score.
_ANY_PHRASE = {
    lang: re.compile("|".join({classes[name].pattern for t in _TEMPLATES[lang][1] for name in t[: 1 + len(t) // 4]}), re.IGNORECASE)
    for lang, classes in _PHRASES.items()
}


def aligned(template: list[str], found: dict[str, list[tuple[int, int]]], gap: int) -> tuple[float, int]:
    """Best score of a template over the phrases of a sentence, in order and with bounded gaps, and where it ends."""
    chains: list[tuple[float, int]] = []  # score and end of every chain so far
    for name in template:
        longer = []
        for begin, end in found[name]:
            before = max((score - GAP_COST * (begin - at) / gap for score, at in chains if 0 <= begin - at <= gap), default=0.0)
            longer.append((1 + max(before, 0.0), end))
        chains += longer
    score, at = max(chains, default=(0.0, 0))
    return score / len(template), at


def declines(sentence: str) -> int | None:
    """Where the best aligned refusal template ends in a sentence; None where none reaches the score."""
    best: tuple[float, int] | None = None
    for lang, (gap, templates) in _TEMPLATES.items():
        if not _ANY_PHRASE[lang].search(sentence):
            continue
        found: dict[str, list[tuple[int, int]]] = {}
        for template in templates:
            for name in template:
                if name not in found:
                    found[name] = [m.span() for m in _PHRASES[lang][name].finditer(sentence)]
                # without one of its classes, a template of few cannot reach the score
                if not found[name] and len(template) - 1 < REFUSAL_SCORE * len(template):
                    break
            else:
                score, at = aligned(template, found, gap)
                if score >= REFUSAL_SCORE and (best is None or score > best[0]):
                    best = score, at
    return best and best[1]


def is_refusal(answer: str) -> bool:
    """Whether an answer declines and none of its sentences answers anything."""
    declined = False
    for sentence in _SENTENCE.split(_CITATION.sub("", answer)):
        if not any(c.isalnum() for c in sentence):
            continue
        if (end := declines(sentence)) is not None and not _CAVEAT.search(sentence, end):
            declined = True
        elif not _POLITE.search(sentence) or _CAVEAT.search(sentence) and not declined:
            return False
    return declined


def is_truncated(answer: str) -> bool:
    """Whether an answer ends in mid-word, mid-sentence or mid-block."""
    body = _CITATION.sub("", answer.rstrip())
    reason = examine(body).reason if body.strip() else None
    if reason in (None, "no_terminator") and _PLAIN_VALUE.fullmatch(body.strip()):
        return False
    if reason != "no_terminator":
        return reason is not None
    if _CODE_END.search(body) or ends_sentence(body):
        return False
    found = tokens(body)
    # a short answer is taken for a value, unless its last word calls for another
    return len(found) > (8 if any("㐀" <= t <= "鿿" for t in found) else 3) or _OPEN_END.search(body) is not None


def in_other_language(question: str, answer: str) -> bool:
    """Whether the answer is not in the question's language, nor in one the question asks for."""
    asked, bare = requested_language(question)
    spoken, expected = language(answer), language(bare)
    return spoken is not None and expected is not None and spoken not in (expected, asked)


def defect(question: str | None, answer: str | None, refusal_appropriate: bool | None) -> str | None:
    """The defect of a pair, or None; the first of empty, copy, refusal, truncated and other_language."""
    shown = _INVISIBLE.sub("", answer or "")
    letters = _NO_LETTER.sub("", shown.lower())
    if not letters or letters in NO_VALUE:
        return "empty"
    question = question or ""
    if is_copy(question, answer):
        return "copy"
    rest = without_question(question, answer)
    if is_refusal(rest):
        return None if refusal_appropriate else "refusal"
    if is_truncated(answer):
        return "truncated"
    return "other_language" if in_other_language(question, rest) else None


def defective_pairs(
    rows: DataFrame, id_col: str = "row_id", question_col: str = "question", answer_col: str = "answer",
    appropriate: str | None = "judge.refusal_appropriate",
) -> DataFrame:
    """``(row_id, defect)`` of the defective pairs, at most one row a pair.

    A null answer is empty.  A null or blank question leaves no copy and no
    language to miss.  ``appropriate`` names a boolean column (or none): a refusal
    where it is true is no defect; where it or the struct around it is null, it is.
    Repeated rows are judged each on their own; other columns are ignored.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [defect(*row) for row in zip(*(c.to_pylist() for c in batch.columns[1:]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["row_id", "defect"])

    proper = F.col(appropriate) if appropriate else F.lit(None).cast("boolean")
    pairs = rows.select(
        F.col(id_col).cast("long").alias("row_id"), F.col(question_col).alias("q"), F.col(answer_col).alias("a"), proper.alias("ok")
    )
    return pairs.mapInArrow(judge, "row_id long, defect string").where("defect is not null")
