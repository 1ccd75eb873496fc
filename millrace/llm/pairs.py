"""Problem 5: prompt and response pairs that are not usable, each with its type of defect.

Method: prompt and response are aligned by shingle containment and longest common subsequence to find copies, and the
response against refusal templates, and families of them whose slots take any of their phrases, to find refusals;
sentences vote on the language by script and function words, and by a character model where they hold none; cut
responses come from problem 4's operator. One pass over the rows besides that operator.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import truncation
from millrace.session import written

#: A copy shares at least these parts of the longer text: shingles of three words, and words in order.
COPY_SHINGLES, COPY_WORDS = 0.8, 0.9
#: A refusal holds a template's words in order at least to this part.
REFUSAL = 0.8
#: A response is in the wrong language if at most this part of what can be told is in the wanted one.
WANTED_SHARE = 0.5

_WORD, _PLAIN_WORD = re.compile(r"[^\W_]+", re.U), re.compile(r"[a-z0-9]+")
_WIDE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")


def words(text: str) -> list[str]:
    """Words in lower case; each ideograph is a word."""
    low = text.lower()
    return _PLAIN_WORD.findall(low) if low.isascii() else _WORD.findall(_WIDE.sub(lambda m: f" {m[0]} ", low))


def common_words(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit-parallel dynamic programming over a's places."""
    place: dict[str, int] = {}
    for i, w in enumerate(a):
        place[w] = place.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for w in b:
        hit = state & place.get(w, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def is_copy(prompt: str | None, response: str | None) -> bool:
    """Whether the response is the prompt and nothing else, whatever its case, spacing and punctuation."""
    if not prompt or not response or len(response) > 4 * len(prompt) + 40 or len(prompt) > 4 * len(response) + 40:
        return False
    a, b = words(prompt), words(response)
    if not a or not b or min(len(a), len(b)) < COPY_WORDS * max(len(a), len(b)):
        return False
    if a == b:
        return True
    if min(len(a), len(b)) < 4:
        return False
    sa, sb = set(zip(a, a[1:], a[2:])), set(zip(b, b[1:], b[2:]))
    shared = len(sa & sb)
    if shared < COPY_SHINGLES * max(len(sa), len(sb)):
        return False
    return common_words(a, b) >= COPY_WORDS * max(len(a), len(b))


# --------------------------------------------------------------------------------------------------- refusals
#: Refusal templates. An asterisk stands for up to three words; a template's words must stand close together, in order.
REFUSALS = [
    "i can't help with", "i cannot help with", "i can not help", "i can't assist", "i cannot assist", "i can't answer", "i cannot answer", "i can't provide", "i cannot provide", "i can't do that", "i cannot comply", "i can't comply", "i won't do", "i will not do", "i won't help", "i won't answer", "i will not answer", "something i won't", "something i cannot", "i am unable to", "i'm unable to", "i am not able to", "i'm not able to", "i must decline", "i have to decline", "i need to decline", "i decline to", "i must refuse", "i have to refuse", "i refuse to", "i would rather not", "i'd rather not", "i prefer not to", "no answer can be given", "no answer from me", "i am not allowed to", "i'm not allowed to", "not permitted to", "against my guidelines", "against my policy", "policy * rules out", "policies prevent me", "guidelines * prevent me", "my guidelines forbid", "you will have to look elsewhere", "you'll have to look elsewhere", "has to stay unanswered", "must remain unanswered", "will remain unanswered", "cannot be answered by me", "falls outside what i may", "since i am only a language model", "as a language model i", "as an ai i", "i do not feel comfortable", "can't discuss", "cannot discuss", "not something i can",
    "ich kann * nicht helfen", "kann ich nicht helfen", "kann ich leider nicht", "ich kann leider nicht", "ich kann * nicht beantworten", "kann ich nicht beantworten", "muss ich ablehnen", "ich muss * ablehnen", "muss ich * ablehnen", "darf ich * keine antwort", "darf ich nicht", "ich darf nicht", "darf keine antwort", "darf ich keine", "keine antwort geben", "nicht beantworten", "bin ich nicht in der lage", "ich bin nicht in der lage", "ich möchte * nicht", "tut mir leid, aber dabei", "das lehne ich ab", "ich lehne * ab", "nicht weiterhelfen", "keine auskunft geben",
    "je ne peux pas", "je ne puis", "je ne suis pas en mesure", "je dois refuser", "je dois décliner", "je refuse de", "je préfère ne pas", "il m'est impossible", "je ne saurais", "impossible de répondre", "je ne suis pas autorisé", "contraire à mes règles", "je regrette de ne pas", "je ne répondrai pas",
    "no puedo ayudar", "no puedo responder", "no puedo contestar", "no puedo atender", "no puedo proporcionar", "no me es posible", "debo rechazar", "tengo que rechazar", "debo negarme", "no estoy en condiciones", "no tengo permitido", "no estoy autorizado", "prefiero no", "me niego a", "no puedo dar", "no puedo ofrecer", "no voy a responder", "no responderé",
    "无法回答", "无法提供", "不能提供", "不能回答", "只能拒绝", "必须拒绝", "无法协助", "不能协助", "无法帮助", "不能帮助", "无可奉告", "不便回答", "拒绝回答", "无法满足", "不能满足", "帮不了", "无法完成这个请求", "不予回答", "不能继续",
]
#: A template with these first words refuses only when nothing but the refusal follows; results after it undo it.
_STATED = r"\s*(?:is|:|：|是|ist|est|es)\s*\\?\w"
#: Forms of a result in lower case, each with what it can't lack.
_RESULT_FORMS = [("####", r"####\s*\S"), ("\\boxed{", r"\\boxed\{[^}]"), ("=", r"=\s*\d"), *((w, w + _STATED) for w in "answer ergebnis antwort résultat réponse resultado respuesta result 答案 结果".split()), ("```", r"```\s*\n\S"), ("=", r"\d\s*[-+*×/]\s*\d+\s*=")]
_RESULT = re.compile("|".join(p for _, p in _RESULT_FORMS), re.I)
_RESULT_FORMS = [(mark, re.compile(p)) for mark, p in _RESULT_FORMS]
#: Letters that a pattern takes for s and i in other case, though their lower case is another.
_FOLDED = re.compile("[ſıİ]")


def gives_result(text: str) -> bool:
    """Whether a result is given, as `_RESULT` says: each form is looked for only where the text holds what it can't lack."""
    low = text.lower()
    if not low.isascii() and _FOLDED.search(text):
        return _RESULT.search(text) is not None
    return any(mark in low and form.search(low) for mark, form in _RESULT_FORMS)


_REFUSAL_WORD, _PLAIN_REFUSAL_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*"), re.compile(r"[a-z0-9]+(?:'[a-z0-9]+)*")


def _refusal_words(text: str) -> list[str]:
    low = text.lower().replace("’", "'")
    return _PLAIN_REFUSAL_WORD.findall(low) if low.isascii() else _REFUSAL_WORD.findall(_WIDE.sub(lambda m: f" {m[0]} ", low))


#: Families of templates: a row of slots, of which each takes any of its phrases, and the words that may stand between two.
_EN_DO = "help|assist|answer|provide|comply|continue|discuss|share|fulfil|fulfill|oblige|engage|respond|support|complete|produce|take on|take part|be of help"
_EN_NO = "decline|refuse|turn down|turn this down|turn it down|turn that down|pass on|say no|abstain|bow out|sit this one out|leave this one|leave it unanswered"
FAMILIES = [
    (2, ["i|we", "can't|cannot|can not|won't|will not|couldn't|could not|may not|mustn't|must not|shall not|am not going to|am not able to|am not allowed to|am not permitted to|am unable to|am unwilling to|would rather not", _EN_DO]),
    (2, ["i'm|we're", "not going to|not able to|not allowed to|not permitted to|not willing to|not in a position to|unable to|unwilling to", _EN_DO]),
    (2, ["i|we", "have to|must|need to|will|shall|am going to|am obliged to|prefer to|choose to", _EN_NO]), (2, ["i'll|we'll|i'd rather|i've to", _EN_NO]),
    (2, ["has to|must|will|should|needs to", "stay unanswered|remain unanswered|go unanswered|be declined|be refused|be turned down"]),
    (1, ["this|that|it", "is", "not something|nothing|beyond what|outside what|more than", "i", "can|may|will|am able|am allowed"]),
    (5, ["ich", "kann|darf|werde|möchte|will", "nicht|keine|kein", "helfen|weiterhelfen|beantworten|antworten|geben|nachkommen|bearbeiten|liefern|erfüllen|unterstützen"]), (5, ["kann|darf|werde|möchte|will", "ich", "nicht|keine|kein", "helfen|weiterhelfen|beantworten|antworten|geben|nachkommen|bearbeiten|liefern|erfüllen|unterstützen"]),
    (6, ["ich", "muss|werde|möchte", "ablehnen|verweigern|absagen|passen"]), (6, ["muss|werde|möchte", "ich", "ablehnen|verweigern|absagen|passen"]),
    (2, ["je", "ne", "peux|puis|vais|saurais|veux|dois", "pas", "aider|vous aider|t'aider|répondre|y répondre|fournir|donner|traiter|continuer|satisfaire|accéder"]), (2, ["je", "dois|préfère|vais|me vois contraint de", "refuser|décliner|m'abstenir|passer mon tour"]),
    (1, ["no", "puedo|podré|voy a|quiero|debo", "ayudar|ayudarte|ayudarle|responder|contestar|atender|proporcionar|ofrecer|continuar|cumplir"]), (2, ["debo|tengo que|prefiero|voy a", "rechazar|negarme|declinar|abstenerme"]),
    (4, ["我", "不能|无法|不会|不便|不可以|没法|不方便|没有办法", "回答|提供|协助|帮助|帮你|帮您|满足|完成|继续|处理|讨论|作答"]), (4, ["我", "只能|必须|不得不|选择", "拒绝|婉拒|谢绝"]),
]
_FAMILIES = [(gap, [sorted((_refusal_words(x) for x in slot.split("|")), key=len, reverse=True) for slot in slots]) for gap, slots in FAMILIES]
_OPENINGS: dict[str, list[tuple[int, list[list[list[str]]]]]] = {}
for _gap, _slots in _FAMILIES:
    for _first in {x[0] for x in _slots[0]}:
        _OPENINGS.setdefault(_first, []).append((_gap, _slots))


def _aligned(w: list[str], at: int, slots: list[list[list[str]]], gap: int) -> bool:
    """Whether the words from a place on fill all slots in order, with at most `gap` other words between two."""
    ends = {at + len(x) for x in slots[0] if w[at : at + len(x)] == x}
    for slot in slots[1:]:
        ends = {k + len(x) for end in ends for k in range(end, end + gap + 1) for x in slot if w[k : k + len(x)] == x}
    return bool(ends)


_TEMPLATES = [_refusal_words(t.replace("*", " ")) for t in REFUSALS]
_BY_FIRST: dict[str, list[list[str]]] = {}
for _t in _TEMPLATES:
    _BY_FIRST.setdefault(_t[0], []).append(_t)
_KEYS = re.compile("|".join(sorted({re.escape(t[-1]) for t in _TEMPLATES if t}, key=len, reverse=True)))


def is_refusal(response: str | None) -> bool:
    """Whether the response declines: a template lies in it, in order and close together, and no result is given."""
    if not response or gives_result(response):
        return False
    w = _refusal_words(response)
    for i, first in enumerate(w):
        for t in _BY_FIRST.get(first, ()):
            room = w[i : i + len(t) + 3]
            if common_words(t, room) >= max(REFUSAL * len(t), min(len(t), 3)) and (len(t) > 3 or common_words(t, room[: len(t) + (len(t) > 1 and "*" in t)]) == len(t)):
                return True
    return any(_aligned(w, i, slots, gap) for i, first in enumerate(w) for gap, slots in _OPENINGS.get(first, ()))


# --------------------------------------------------------------------------------------------------- language
#: Function words and frequent words by language, without those that the languages share.
FUNCTION_WORDS = {
    "en": "the of and to is that it for with as was on be by this are from at or have which not an we how what each many they does still when if then every between our here into than more while answer result hence so arithmetic whatever neither nor its find reply write please why give number let suppose another does do you i can complete".split(),
    "de": "der die das und ist nicht wird mit dem den ein eine wie für aus im zu dass auch sein werden wenn trotz am bei nach ich sie es auf von sich aber dann somit folgt wert man ergebnis antwort warum was sind viele jedem bleibt hier leider keine kann noch nur unter zwischen sehen wir".split(),
    "fr": "le les et est des une du que qui dans pour sur au par ne pas avec ce cette cet on il sont aux chaque combien entre donc comme à résultat réponse calcule calcul donne si manque ensuite suffit soit plus reste en elle nous vous je un quelle quel vaut tout".split(),
    "es": "el los las y una del por con para se lo hay al es un que no más cada cuántas cuántos cuál entre su esta ese esa este vemos como resultado respuesta cuenta da calcula si falta después así además quedan le lo son por tanto ya muy sin cuánto vale retiran".split(),
}
#: Words that only these further languages use, so that they are not taken for their neighbours.
FUNCTION_WORDS |= {
    "it": "che di della delle degli sono perché questo questa gli nella anche più però è quindi così quanti quante ogni dalla nel alla".split(),
    "pt": "não uma são você isso também os das dos pelo pela está então muito mais quantos quantas cada ao à até foi nós".split(),
    "nl": "het een niet zijn wordt voor met aan ook dan maar deze naar bij uit hoeveel elke omdat dus wij".split(),
}
FUNCTION_WORDS["it"] = [w for w in FUNCTION_WORDS["it"] if not any(w in FUNCTION_WORDS[k] for k in ("en", "de", "fr", "es"))]
FUNCTION_WORDS["pt"] = [w for w in FUNCTION_WORDS["pt"] if not any(w in FUNCTION_WORDS[k] for k in ("en", "de", "fr", "es"))]
FUNCTION_WORDS["nl"] = [w for w in FUNCTION_WORDS["nl"] if not any(w in FUNCTION_WORDS[k] for k in ("en", "de", "fr", "es"))]
#: Scripts that tell the language, or one of few, by code points.
SCRIPTS = [("ja", re.compile("[\u3040-\u30ff]")), ("ko", re.compile("[\uac00-\ud7af\u1100-\u11ff]")), ("zh", re.compile("[\u3400-\u9fff]")), ("ru", re.compile("[\u0400-\u04ff]")), ("el", re.compile("[\u0370-\u03ff]")), ("ar", re.compile("[\u0600-\u06ff]")), ("he", re.compile("[\u0590-\u05ff]")), ("hi", re.compile("[\u0900-\u097f]")), ("th", re.compile("[\u0e00-\u0e7f]"))]
#: Texts from which the character model learns its languages.
SEEDS = {
    "en": "the weather was fine this morning and we went down to the river to see whether the boats had come back before the others woke up she said that nothing would change until the end of the month because everyone had already been paid there are many reasons why people choose to live in a small town where they know their neighbours and can walk to work without any trouble",
    "de": "das wetter war heute morgen schön und wir gingen zum fluss hinunter um zu sehen ob die boote zurück waren bevor die anderen aufwachten sie sagte dass sich bis zum ende des monats nichts ändern würde weil alle schon bezahlt worden waren es gibt viele gründe warum menschen lieber in einer kleinen stadt leben wo sie ihre nachbarn kennen und ohne mühe zur arbeit gehen können",
    "fr": "le temps était beau ce matin et nous sommes descendus à la rivière pour voir si les bateaux étaient revenus avant que les autres ne se réveillent elle a dit que rien ne changerait avant la fin du mois parce que tout le monde avait déjà été payé il y a beaucoup de raisons pour lesquelles les gens choisissent de vivre dans une petite ville où ils connaissent leurs voisins et peuvent aller au travail sans peine",
    "es": "el tiempo era bueno esta mañana y bajamos al río para ver si los barcos habían vuelto antes de que los demás se despertaran ella dijo que nada cambiaría hasta el final del mes porque todos ya habían cobrado hay muchas razones por las que la gente elige vivir en una ciudad pequeña donde conoce a sus vecinos y puede ir andando al trabajo sin ningún problema",
    "it": "il tempo era bello questa mattina e siamo scesi al fiume per vedere se le barche erano tornate prima che gli altri si svegliassero lei ha detto che niente sarebbe cambiato fino alla fine del mese perché tutti erano già stati pagati ci sono molte ragioni per cui la gente sceglie di vivere in una piccola città dove conosce i vicini e può andare al lavoro senza fatica",
    "pt": "o tempo estava bom esta manhã e descemos ao rio para ver se os barcos tinham voltado antes que os outros acordassem ela disse que nada mudaria até ao fim do mês porque todos já tinham sido pagos há muitas razões pelas quais as pessoas escolhem viver numa cidade pequena onde conhecem os seus vizinhos e podem ir a pé para o trabalho sem nenhum problema",
    "nl": "het weer was mooi vanochtend en we gingen naar de rivier om te zien of de boten terug waren voordat de anderen wakker werden zij zei dat er niets zou veranderen tot het einde van de maand omdat iedereen al betaald was er zijn veel redenen waarom mensen ervoor kiezen om in een kleine stad te wonen waar ze hun buren kennen en zonder moeite naar hun werk kunnen lopen",
}
#: A sentence of fewer letters or different words is left to its function words; and by how much a letter the best language
#: must be likelier than the second.
LETTERS, DIFFERENT, CLEARLY = 20, 4, 0.2


@lru_cache(maxsize=1)
def _trigrams() -> tuple[dict[str, int], np.ndarray, np.ndarray, list[str]]:
    """Trigrams by number, their log-probabilities by language, those of unseen ones, and the languages."""
    names = list(SEEDS)
    counts: dict[str, np.ndarray] = {}
    for k, name in enumerate(names):
        for w in [*SEEDS[name].split(), *FUNCTION_WORDS.get(name, [])]:
            padded = f" {w} "
            for i in range(len(padded) - 2):
                counts.setdefault(padded[i : i + 3], np.zeros(len(names)))[k] += 1
    table = np.array(list(counts.values()))
    total = table.sum(0) + 0.3 * 4000
    return {g: i for i, g in enumerate(counts)}, np.log((table + 0.3) / total), np.log(0.3 / total), names


@lru_cache(maxsize=200_000)
def _word_likelihood(word: str) -> tuple[float, ...]:
    known, table, unseen, _ = _trigrams()
    padded = f" {word} "
    rows = [known.get(padded[i : i + 3], -1) for i in range(len(padded) - 2)]
    return tuple(sum((table[r] if r >= 0 else unseen) for r in rows))


def likely_language(words: list[str]) -> str | None:
    """The language whose trigrams make the words clearly likelier than any other's do."""
    letters = sum(map(len, words))
    if letters < LETTERS or len(set(words)) < DIFFERENT:
        return None
    total = np.sum([_word_likelihood(w) for w in words], 0)
    best, second = np.argsort(-total)[:2]
    return _trigrams()[3][best] if total[best] - total[second] >= CLEARLY * letters else None


_LANGUAGE_OF = {w: [k for k, v in FUNCTION_WORDS.items() if w in v] for v in FUNCTION_WORDS.values() for w in v}
_MARKS = [("pt", re.compile("[ãõ]")), ("de", re.compile("[ßäöü]")), ("es", re.compile("[ñáíóú]")), ("fr", re.compile("[àâçêëîïôùûœè]"))]
#: One search tells whether any of SCRIPTS or of _MARKS can be found.
_SCRIPT, _MARK = (re.compile("[" + "".join(p.pattern.strip("[]") for _, p in x) + "]") for x in (SCRIPTS, _MARKS))
_CODE = re.compile(r"```.*?(?:```|\Z)|\\[a-z]+\{[^}]*\}", re.S)


_STOP = re.compile(r"[.!?。！？\n]")
_LETTERS, _PLAIN_LETTERS = re.compile(r"[^\W\d_]+|'"), re.compile(r"[a-z]+|'")
_TAIL = re.compile(r"\b(?:[ldnsjmc]|qu)['’]")


def _told(text: str | None) -> Iterator[tuple[str, int, int]]:
    """Of each sentence that can be told its language and characters, and how many may follow at most."""
    if not text:
        return
    if "\\" in text or "`" in text:
        text = _CODE.sub(" ", text)
    low = text.lower()
    letters, each = (_PLAIN_LETTERS, 1) if low.isascii() else (_LETTERS, 2)  # an ideograph counts twice
    left = len(low)
    for part in _STOP.split(low):
        left -= len(part)
        sentence = letters.findall(part)
        if sentence:
            language, size = _vote(sentence)
            if language:
                yield language, size, each * left


def languages(text: str | None) -> dict[str, int]:
    """Characters of the text by language; sentences that can't be told are left out."""
    out: dict[str, int] = {}
    for language, size, _ in _told(text):
        out[language] = out.get(language, 0) + size
    return out


def _vote(sentence: list[str]) -> tuple[str | None, int]:
    """The language of one sentence's words and its letters."""
    joined = " ".join(sentence)
    letters = len(joined) - joined.count(" ") - joined.count("'")
    plain = joined.isascii()
    if not plain and _SCRIPT.search(joined):
        for k, pattern in SCRIPTS:
            n = len(pattern.findall(joined))
            if n > 0.1 * letters and k == "ja" or n > 0.3 * letters:
                return k, 2 * len(_WIDE.findall(joined)) or letters
    if len(sentence) > 5 and len(set(sentence)) < 3:  # a loop of a syllable is in no language
        return None, 0
    votes: dict[str, float] = {}
    for known in filter(None, map(_LANGUAGE_OF.get, sentence)):
        for k in known:
            votes[k] = votes.get(k, 0) + 1 / len(known)
    if not plain and _MARK.search(joined):
        for k, pattern in _MARKS:
            n = len(pattern.findall(joined))
            if n:
                votes[k] = votes.get(k, 0) + min(n, 3)
    if "'" in sentence:
        n = len(_TAIL.findall(joined.replace(" ' ", "'")))
        if n:
            votes["fr"] = votes.get("fr", 0) + min(n, 3)
    if not votes:
        return likely_language(sentence), letters
    most = max(votes.values())
    best = [k for k, v in votes.items() if v == most]
    return (best[0], letters) if len(best) == 1 else (None, 0)


#: How languages are named in a request.
LANGUAGE_NAMES = {
    "en": "english englisch anglais inglés ingles 英文 英语".split(),
    "de": "german deutsch allemand alemán aleman 德文 德语".split(),
    "fr": "french französisch français francais francés frances 法文 法语".split(),
    "es": "spanish spanisch espagnol español espanol castellano 西班牙文 西班牙语 西语".split(),
    "zh": "chinese mandarin chinesisch chinois chino 中文 汉语 普通话".split(),
    "it": "italian italienisch italien italiano 意大利语".split(),
    "pt": "portuguese portugiesisch portugais portugués 葡萄牙语".split(),
    "ru": "russian russisch russe ruso 俄语".split(),
    "ja": "japanese japanisch japonais japonés 日语".split(),
    "ko": "korean koreanisch coréen coreano 韩语".split(),
    "ar": "arabic arabisch arabe árabe 阿拉伯语".split(),
}
_NAMED = {n: k for k, v in LANGUAGE_NAMES.items() for n in v}
_ASK = re.compile(r"(?:repl|answer|respon|write|use|antwort|schreib|répon|écri|rédig|contest|escrib|用|以|回答|作答|in |auf |en )[^.!?。！？\n]{0,30}?(" + "|".join(sorted(map(re.escape, _NAMED), key=len, reverse=True)) + r")(?![^\W\d_]*\w)?", re.I)


@lru_cache(maxsize=100_000)
def wanted_language(prompt: str | None) -> str | None:
    """The language a prompt asks for, or else the one it is written in; None if neither can be told."""
    if not prompt:
        return None
    low = prompt.lower()
    named = any(n in low for n in _NAMED) or not low.isascii() and _FOLDED.search(prompt)
    asked = _ASK.findall(prompt) if named else []
    if asked:
        return _NAMED[asked[-1].lower()]
    found = languages(prompt)
    return max(found, key=found.get) if found else None


def wrong_language(prompt: str | None, response: str | None) -> bool:
    """Whether the response is for the most part not in the wanted language. What can't be told is not wrong."""
    wanted = wanted_language(prompt)
    if not wanted:
        return False
    held = total = 0
    for language, size, left in _told(response):
        total += size
        held += size if language == wanted else 0
        if held >= WANTED_SHARE * (total + left):  # whatever follows
            return False
    return bool(total) and held < WANTED_SHARE * total


def defects(prompt: str | None, response: str | None) -> list[str]:
    """The defects of one pair that its own texts show; an empty response, a copy and a refusal have no other."""
    if truncation.blank(response):
        return ["empty"]
    if is_copy(prompt, response):
        return ["copy"]
    if is_refusal(response):
        return ["refusal"]
    return ["wrong_language"] if wrong_language(prompt, response) else []


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective pairs of both tables. A cut response is 'truncated' unless it is empty, a copy or a refusal.

    Null responses are empty; a null prompt can show no copy and asks for no language. Repeated ids count once.
    """
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    every = written(truncation.measured(read("rollout"), read("vocab"), read("eval_results"), defects), "pairs")
    judged = truncation.cut_records(every)
    sole = F.filter("defects", lambda d: d.isin("empty", "copy", "refusal"))
    kept = F.when(F.size(sole) > 0, sole).when(F.col("cut"), F.array_union("defects", F.array(F.lit("truncated")))).otherwise(F.col("defects"))
    return judged.select("src", "record_id", F.explode(kept).alias("defect"))
