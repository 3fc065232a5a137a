"""Language of a short text by script and function words; code and names have no language."""

from __future__ import annotations

import re
from collections import Counter

#: Frequent function words of each language.
FUNCTION_WORDS = {
    "en": "the a an and or of to in on at by for with from is are was were be been has have had do does did not no this that "
    "these those it its as if when where which who what why how can could would should will than then there so but into "
    "about after before until while because once only every each both all any some over under out off just nothing they "
    "them their you your we our i my he she his her yes please",
    "de": "der die das den dem des ein eine einen einem einer eines und oder von zu zum zur im in an auf bei für mit aus ist sind "
    "war waren wird werden wurde hat haben nicht kein keine dieser diese dieses es als wenn wann wo welche welcher welches wer "
    "was warum wie kann können würde soll dann nur aber über unter nach vor bis während weil sobald falls solange obwohl jede "
    "jeder jedes alle sie er wir ich ihr sein seine auch noch schon nachdem bevor passiert bitte ja nein dafür gegen rund",
    "es": "el la los las un una unos unas y o de del al a en con por para sin es son era fue ser está han ha hay no este esta estos "
    "estas ese esa eso que qué como cómo cuando cuándo donde dónde cuál cuáles quién si sí se su sus lo le les más pero solo "
    "sobre tras antes después hasta mientras porque aunque cada todo todos nada muy ya nos yo usted ocurre puede sea según unos",
    "fr": "le la les un une des et ou de du au aux à en dans sur avec par pour sans est sont était été être a ont ne pas ce cette "
    "ces cet que qui quoi comme comment quand où quel quelle quels quelles si se sa son ses leur leurs il elle ils elles on nous "
    "vous je tu plus mais seulement après avant jusqu pendant parce dès tant chaque tout tous rien très puis pourquoi peut soit "
    "lorsque quelles deviennent personne",
    "it": "il lo gli uno una e di del della dei delle al alla in con per da è sono era non questo questa che chi come quando dove "
    "perché se ma più anche solo dopo prima mentre ogni tutto nel nella sul",
    "pt": "o os as um uma e do da dos das ao à em no na nos nas com por para é são foi não este esta isso que quem como quando onde "
    "porque se mas mais também só depois antes enquanto cada tudo pelo pela",
    "nl": "de het een en of van te naar op bij voor met uit is zijn was waren wordt werd heeft hebben niet geen deze dit dat die als "
    "wanneer waar wie wat waarom hoe kan maar over onder na tot omdat elke alle ook nog",
}
#: The languages of each function word.
_SPEAKERS = {w: [lang for lang, words in FUNCTION_WORDS.items() if w in words.split()] for words in FUNCTION_WORDS.values() for w in words.split()}
#: Letters that hint at one language.
_LETTERS = {"de": "äöüß", "es": "ñ¿¡", "fr": "çœêèàùûî", "pt": "ãõ"}

_CODE = re.compile(
    r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|`[^`\n]*`|https?://[!-~]+"
    r"|(?<![A-Za-z0-9.-])[A-Za-z0-9.-]*[_/\\=<>{}][A-Za-z0-9_./\\=<>{}-]*|\[\d+\]",
    re.DOTALL,
)
_SCRIPTS = {
    "ja": re.compile(r"[぀-ヿ]"),
    "ko": re.compile(r"[가-힯]"),
    "zh": re.compile(r"[㐀-鿿]"),
    "ru": re.compile(r"[Ѐ-ӿ]"),
    "ar": re.compile(r"[؀-ۿ]"),
    "el": re.compile(r"[Ͱ-Ͽ]"),
}
_WORD = re.compile(r"[^\W\d_]+")


def language(text: str) -> str | None:
    """The language most of a text is in; None where too little tells."""
    prose = _CODE.sub(" ", text)
    words = [w for w in _WORD.findall(prose) if w.isascii() or not any(p.search(w) for p in _SCRIPTS.values())]
    votes = Counter({lang: len(p.findall(prose)) / 2 for lang, p in _SCRIPTS.items()})
    if votes["ja"] * 8 > votes["zh"] > 0 < votes["ja"]:
        votes["ja"] += votes.pop("zh")
    script, weight = votes.most_common(1)[0]
    # names keep their capitals and have no language
    spoken = [w for n, w in enumerate(words) if w.islower() or n == 0 or w.isupper()]
    if weight and weight >= 1.5 and weight * 2 >= len(spoken):
        return script
    score = dict.fromkeys(FUNCTION_WORDS, 0.0)
    for word in words:
        for lang in _SPEAKERS.get(word.lower(), ()):
            score[lang] += 1
    low = prose.lower()
    for lang, letters in _LETTERS.items():
        score[lang] += 0.7 * sum(low.count(c) for c in letters)
    (best, top), (_, second) = Counter(score).most_common(2)
    if top >= 1 and top > second:
        return best
    return script if weight >= 1 and weight > top else None


#: Names of languages in the languages themselves.
_NAMES = {
    "en": r"english|englisch(?:en)?|anglais|ingl[ée]s|inglese|英文|英语|英語",
    "zh": r"chinese|chinesisch(?:en)?|chinois|chino|mandarin|中文|汉语|漢語",
    "de": r"german|deutsch(?:en)?|allemand|alem[áa]n|德文|德语",
    "es": r"spanish|spanisch(?:en)?|espagnol|español|西班牙文|西班牙语|西语",
    "fr": r"french|französisch(?:en)?|français|franc[ée]s|法文|法语",
    "it": r"italian|italienisch(?:en)?|italien|italiano|意大利语",
    "pt": r"portuguese|portugiesisch(?:en)?|portugais|portugués|葡萄牙语",
    "ja": r"japanese|japanisch(?:en)?|japonais|japonés|日文|日语|日本語",
}
_ASKED = {
    lang: re.compile(
        rf"\b(?:in|auf|en|em|into|to)\s+(?:{names})|(?:用|以|译成|翻译成|翻成)\s*(?:{names})", re.IGNORECASE
    )
    for lang, names in _NAMES.items()
}
_SENTENCE_EDGE = re.compile(r"[.!?。！？()（）]")
_REQUEST = re.compile(
    r"please|answer|repl[yi]|respond|write|translat|bitte|antwort|schreib|übersetz|répon|écri|tradui|s'il|respond|contest|escrib|traduc|por favor|请|回答|作答|翻译|译|写",
    re.IGNORECASE,
)


def requested_language(question: str) -> tuple[str | None, str]:
    """A language that the question asks to be answered in, and the question without the sentence that asks."""
    for lang, asked in _ASKED.items():
        for m in asked.finditer(question):
            begin = max((e.end() for e in _SENTENCE_EDGE.finditer(question, 0, m.start())), default=0)
            edge = _SENTENCE_EDGE.search(question, m.end())
            end = edge.end() if edge else len(question)
            if _REQUEST.search(question, begin, end):
                rest = question[:begin] + " " + question[end:]
                return lang, rest if any(c.isalpha() for c in rest) else question
    return None, question
