"""Broken prompt and response pairs: empty, truncated, refused, copied or in another language."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigrade.operators.skew import hot_keys, salted_join
from verdigrade.session import materialize

DEFECTS = ("empty", "copy", "refusal", "language", "truncated")

# Labels that lead an answer or a restated question in.
ANSWER_LABEL = r"(?:(?:the |my |final |short )?(?:answer|response|reply|output|result|completion)|antwort|ausgabe|ergebnis|r[eé]ponse|sortie|r[eé]sultat|respuesta|salida|resultado|risposta|resposta|assistant|a)"
QUESTION_LABEL = r"(?:(?:the |your |my |original |user )?(?:question|prompt|query|input|task|instruction|request)(?: was| is| reads)?|you asked(?: me)?|you (?:wrote|said)|q|user|(?:ihre |die |deine )?frage(?: war| lautete?| ist)?|sie fragten|(?:votre |la )?question(?: [eé]tait| est)?|vous avez demand[eé]|(?:su |la |tu )?pregunta(?: era| fue| es)?|usted pregunt[oó]|preguntaste|la domanda(?: era)?|domanda|pergunta)"
# What stands where an answer should be.
STAND_INS = frozenset(
    "null none nil nan n/a na n.a. undefined void empty blank missing tbd todo no answer|no response|no output|no content|no result|no text|no reply|not answered|not available|not applicable|"
    "empty response|empty answer|empty output|answer missing|answer not available|answer not found|keine antwort|leer|nicht verfügbar|aucune réponse|pas de réponse|vide|sin respuesta|vacío|ninguna respuesta|nessuna risposta|sem resposta|unanswered|"
    "left blank|intentionally left blank|placeholder|your answer here|answer here|insert answer here|output|answer|response".replace(" no answer|", "|no answer|").replace("null none nil nan n/a na n.a. undefined void empty blank missing tbd todo", "null|none|nil|nan|n/a|na|n.a.|undefined|void|empty|blank|missing|tbd|todo").split("|")
)
# Words of each language that others hardly use; a word in several lists counts for less.
FUNCTION_WORDS = {
    "en": "the of and is was were are be been it its that this these those with from at by for on in not they he she his her their has have had will would there which who what when where because of before after than only by into about them you your we our i a an to as or if so but all one of mostly between during yes how many does did now then there's can could may no never month last day days year week hours",
    "de": "der die das den dem des ein eine einen einem einer und ist war waren sind nicht mit von vom zum zur im am auf aus bei für wegen es er sie ihr ich wir auch noch nur nach über unter durch wurde wurden haben hat hatte kein keine davon dass wenn weil denn als wie wer bis dort laut ja nein sehr blieb seit um warum wieviele viele wann wo welche welcher welches zwischen sich dann so nun mir dabei kann darf muss monat letzten letzte tag tage tagen jahr woche stunden",
    "fr": "de le la les des du un une et est était étaient sont ne pas par pour dans sur avec sans au aux ce cette ces qui que quoi dont il elle ils elles nous vous je son sa ses leur à où car jusqu jusqu'au avant après été avait avaient oui non cela c'est d'eau y lui chez très mais ont en combien pourquoi comment quel quelle quand cause fait être même plus puis alors aussi mois jour jours année dernier dernière semaine heure",
    "es": "de el la los las un una unos unas y es era fue fueron son no con del al por para en que se su sus lo como más pero porque según así quien cuando donde estaba estaban había hay ha han después antes hasta sí este esta ese esa muy cuántas cuántos cuál qué quién cuándo dónde entre sobre desde también ya me nos pasado día días año semana horas",
    "it": "il lo la i gli le un una uno e è era erano sono non con del della dello dei degli delle al alla allo dal dalla nel nella sul sulla per in che chi cui di da si come più ma perché dopo prima furono fu ha hanno c'era c'erano questo questa anche molto sì quanti quante dove quando tra fra sopra già ci ne agli ai mese scorso giorno giorni anno settimana ore",
    "pt": "de o a os as um uma uns umas e é era foram são não com do da dos das ao à no na nos nas por para em que se como mais mas porque depois antes isso isto está estava estavam havia há foi tem seu sua pelo pela muito sim quantas quantos quem onde quando entre sobre também já à às nós mês passado dia dias ano semana horas",
    "pl": "i w z na do nie się jest są był była było byli to że od po za dla przez przy o a ale jak ponieważ czego które który która ich jego jej oraz tak był za ten ta te tym co kto gdzie kiedy sztuk tylko już lub czy bo",
    "sv": "och att det som en ett är var på för med av till den har inte om vi jag han hon de från eller men så när där efter före blev hade kan ska mycket också",
    "cs": "a v na je se že to s z do o k i ale pro byl byla bylo byly jsou jak protože který která které od po za když jen nebo také už jeho její tak ve ze",
    "ro": "și în de la cu pe un o este sunt nu că din pentru a fost au mai dar sau care după înainte lui ei era foarte când unde prin",
    "tr": "ve bir bu da de için ile olarak daha çok en ne o gibi kadar sonra önce değil var yok olan oldu ama çünkü şu her nerede",
    "nl": "de het een en is was waren zijn niet met van voor op in aan bij door uit naar om dat die dit deze er hij zij wij ik ook nog maar omdat als wie wat waar werd werden heeft hebben had geen ja nee zeer tot na over onder",
}
# Letters that mark a language, and names that a question asks for a language with.
LETTERS = {"de": "ßäöü", "fr": "çœêèùîûôë", "es": "ñ¿¡", "pt": "ãõ", "it": "ìò", "pl": "łżśćźńęą", "sv": "åäö", "cs": "řěůčšž", "ro": "ășțâ", "tr": "ğışç"}
LANGUAGE_NAMES = {
    "en": "english|englisch(?:e[nrs]?)?|anglais|ingl[eé]s(?:a)?|inglese", "de": "german|deutsch(?:e[nrs]?)?|allemand|alem[aá]n|tedesco", "fr": "french|franz[oö]sisch(?:e[nrs]?)?|fran[cç]ais(?:e)?|franc[eé]s|francese",
    "es": "spanish|spanisch(?:e[nrs]?)?|espagnol(?:e)?|espa[nñ]ol(?:a)?|castellano|spagnolo|espanhol", "it": "italian|italienisch(?:e[nrs]?)?|italien(?:ne)?|italiano?", "pt": "portuguese|portugiesisch(?:e[nrs]?)?|portugais|portugu[eé]s",
    "pl": "polish|polnisch(?:e[nrs]?)?|polonais|polaco|polacco", "sv": "swedish|schwedisch(?:e[nrs]?)?|su[eé]dois|sueco", "cs": "czech|tschechisch(?:e[nrs]?)?|tch[eè]que|checo", "ro": "romanian|rum[aä]nisch(?:e[nrs]?)?|roumain|rumano", "tr": "turkish|t[uü]rkisch(?:e[nrs]?)?|turc|turco",
    "nl": "dutch|niederl[aä]ndisch(?:e[nrs]?)?|n[eé]erlandais|neerland[eé]s|holand[eé]s", "GREEK": "greek|griechisch(?:e[nrs]?)?|grec(?:que)?|griego", "CYRILLIC": "russian|russisch(?:e[nrs]?)?|russe|ruso|ukrainian|bulgarian",
    "CJK": "japanese|japanisch(?:e[nrs]?)?|japonais|japon[eé]s|chinese|chinesisch(?:e[nrs]?)?|chinois|chino", "HANGUL": "korean|koreanisch|cor[eé]en|coreano", "ARABIC": "arabic|arabisch|arabe|[aá]rabe|persian", "HEBREW": "hebrew|hebr[aä]isch", "DEVANAGARI": "hindi", "THAI": "thai",
}
# Words after which no sentence ends, in the languages above.
OPEN_WORDS = frozenset(
    "the a an of and or but nor with without from into onto by for at in on to than that which who whose whom because since although though while if when where as is are was were be been being am has have had will would shall should "
    "can could may might must do does did not very their its his our your my this these those each every some any no such so about between among during before after under over until "
    "der die das den dem des ein eine einen einem einer und oder aber mit ohne von vom zum zur im am auf aus bei für wegen dass weil wenn als wie ist war sind waren wird wurde wurden hat haben hatte nicht sehr "
    "le la les des du un une et ou mais avec sans par pour dans sur au aux de que qui dont est était sont ne très "
    "el los las una y o pero con sin por para del al en que se su lo es era fue son muy "
    "il lo gli uno e ma con senza per di da del della dei nel nella che è era sono os as um uma com sem do da dos das no na em foi são".split()
) - frozenset("in on no so this that one about over after before under by his".split())

_GREEN = re.compile(r"[^\W_]+")
_LETTERS_ONLY = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_INVISIBLE = re.compile("[\\s­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯⠀ㅤ︀-️﻿ﾠ\x00-\x1f\x7f-\x9f]+")
_TAG = re.compile(r"</?[A-Za-z][\w:-]*(?:\s[^<>]*)?/?>")
#: A tag with attributes only: words in angle brackets may be an answer.
_ATTRIBUTES = re.compile(r"<[A-Za-z][\w:-]*(?:\s+(?:[\w:@.-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>=]+)|hidden|disabled|checked|required|readonly|selected|open))*\s*/?>")
_FENCE_LINE = re.compile(r"(?m)^[ \t]*(?:```+|~~~+)[ \t]*[\w+-]*[ \t]*$")
_ANSWER_LABEL = re.compile(rf"^\W*{ANSWER_LABEL}\s*[:：=>-]+\s*", re.I)
_QUESTION_LABEL = re.compile(rf"^\W*{QUESTION_LABEL}\s*[:：\-–>]+\s*", re.I)


def is_empty(text: str | None) -> bool:
    """No answer at all: nothing visible, or a stand-in, wrapper or label without content."""
    if text is None:
        return True
    if _SIX_WORDS.search(_ATTRIBUTES.sub(" ", text) if "<" in text else text):
        return False
    rest = _INVISIBLE.sub(" ", text).strip()
    for _ in range(4):
        before = rest
        rest = _FENCE_LINE.sub(" ", rest).replace("```", " ")
        rest = _TAG.sub(" ", rest)
        rest = re.sub(rf"^\W*{ANSWER_LABEL}\s*[:：]\s*", "", rest, flags=re.I).strip()
        if rest == before:
            break
    if not any(unicodedata.category(c) in _CONTENT for c in rest):
        return True
    return len(rest) <= 60 and " ".join(re.sub(r"^[\W_]+|[\W_]+$", "", rest).casefold().split()) in STAND_INS


#: No stand-in with its label has six words in a row once tags and their attributes are taken out.
_SIX_WORDS = re.compile(r"(?:[^\W_]{2,}[^\w<>/`]+){5}[^\W_]{2,}")
_CONTENT = frozenset("Lu Ll Lt Lm Lo Nd Nl No So Sc".split())


def normal_words(text: str) -> list[str]:
    return _GREEN.findall(unicodedata.normalize("NFKC", text).casefold() if not text.isascii() else text.lower())


def _words_of(question: str) -> tuple[list[str], int]:
    """Normal words of a question, and their letters: no text with fewer can repeat it."""
    q = normal_words(question)
    return q, sum(map(len, q))


_question_words = lru_cache(20_000)(_words_of)


def _windows(ids: np.ndarray, size: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A hash of every window of `size` ids: doubled window lengths are put together, so the cost is a logarithm of size."""
    out = acc = None
    have, step, part = 0, 1, ids.astype(np.uint64)
    with np.errstate(over="ignore"):
        while True:
            if size & step:
                acc = part.copy() if acc is None else acc[: len(ids) - have - step + 1] * np.uint64((base * (2 * step + 1)) & 0xFFFFFFFFFFFFFFFF) + part[have : have + len(ids) - have - step + 1]
                have += step
            if have == size:
                out = acc[: len(ids) - size + 1]
                break
            part = part[: len(part) - step] * np.uint64((base * (2 * step)) & 0xFFFFFFFFFFFFFFFF) + (part[step:] ^ (part[step:] >> np.uint64(29)))
            step *= 2
    return out


def tiling(a: list[str], b: list[str], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Greedy string tiling of two word sequences: for each word of a and of b, the number of its tile, or -1.

    Tiles are pairs of equal stretches of at least `least` words. The longest stretches that no tile has
    marked yet become tiles first; a word is in one tile at most. Stretches are searched by hashes of
    windows whose length is halved until it is `least`, and extended as far as they go.
    """
    of_a, of_b = np.full(len(a), -1), np.full(len(b), -1)
    size = min(len(a), len(b))
    if size < max(1, least):
        return of_a, of_b
    number: dict[str, int] = {}
    ids_a, ids_b = (np.array([number.setdefault(w, len(number)) for w in x], np.int64) for x in (a, b))
    n_tiles = 0
    while True:
        while True:
            free_a, free_b = _free(of_a, size), _free(of_b, size)
            at: dict[int, list[int]] = {}
            for i, h in zip(np.flatnonzero(free_a).tolist(), _windows(ids_a, size)[free_a].tolist()):
                at.setdefault(h, []).append(i)
            found = []
            for j, h in zip(np.flatnonzero(free_b).tolist(), _windows(ids_b, size)[free_b].tolist()):
                for i in at.get(h, ()):
                    k = 0
                    while i + k < len(a) and j + k < len(b) and of_a[i + k] < 0 and of_b[j + k] < 0 and ids_a[i + k] == ids_b[j + k]:
                        k += 1
                    if k >= size:
                        found.append((-k, j, i))
                        if k >= 2 * size:
                            break
            new = 0
            for k, j, i in sorted(found):
                if (of_a[i : i - k] < 0).all() and (of_b[j : j - k] < 0).all():
                    of_a[i : i - k] = of_b[j : j - k] = n_tiles
                    n_tiles, new = n_tiles + 1, new + 1
            if not new:
                break
        if size <= least:
            return of_a, of_b
        size = max(least, size // 2)


def _free(of: np.ndarray, size: int) -> np.ndarray:
    marked = np.concatenate(([0], np.cumsum(of >= 0)))
    return marked[size:] == marked[:-size]


def _period(ws: list[str]) -> int:
    """Length of the shortest stretch whose repetition, the last one perhaps cut, gives the words."""
    border = [0] * len(ws)
    k = 0
    for i in range(1, len(ws)):
        while k and ws[i] != ws[k]:
            k = border[k - 1]
        k += ws[i] == ws[k]
        border[i] = k
    return len(ws) - (border[-1] if ws else 0)


_COLON_LABEL, _LABEL_SIGN = re.compile(r"[^\n:：]{1,40}[:：]"), re.compile(r"[:：\-–>]")
#: Words of the shortest tile by which a copy is told, and the share of the question and of the answer that tiles must cover.
TILE_WORDS, COPY_SHARE = 3, 1.0


def copied(question: list[str], answer: list[str], least: int = TILE_WORDS) -> tuple[float, np.ndarray]:
    """Share of the question that tiles find in the answer, and which words of the answer lie in tiles.

    Where the answer holds the question more than once it is tiled again with the whole question.
    """
    least = min(least, len(question))
    in_tiles, share = np.zeros(len(answer), bool), 0.0
    while True:
        rest = np.flatnonzero(~in_tiles)
        of_q, of_a = tiling(question, [answer[i] for i in rest.tolist()], least)
        if not (of_a >= 0).any():
            return share, in_tiles
        in_tiles[rest[of_a >= 0]] = True
        share = max(share, float((of_q >= 0).mean()))
        if not (of_q >= 0).all():
            return share, in_tiles


def is_copy(question: str | None, answer: str, share: float = COPY_SHARE) -> bool:
    """The answer is the question again and nothing else: lead-in labels, quotes, order and repetition aside.

    Decided by greedy string tiling: tiles must cover at least `share` of the question's words and of the
    answer's. Tiles are of TILE_WORDS words at least, so the same single words in another order are no copy,
    and the same sentences or clauses in another order are one. An answer that goes round is tiled once.
    """
    if not question:
        return False
    q, letters = _question_words(question) if len(question) <= 1000 else _words_of(question)
    if not q or share >= 1 and len(answer) < letters and answer.isascii():
        return False
    body = _ANSWER_LABEL.sub("", answer, count=1)
    a = normal_words(body)
    known = set(q)
    unknown = sum(w not in known for w in a)
    if len(a) < share * len(q) or unknown and share >= 1 and not _LABEL_SIGN.search(body):
        return False
    label = _QUESTION_LABEL.match(body) or _COLON_LABEL.match(body)
    lead = normal_words(label.group()) if label else []
    lead = lead if a[: len(lead)] == lead != q[: len(lead)] else []
    labelled = len(lead) * (1 + len(a) // len(q))
    if unknown > (1 - share) * len(a) + labelled:
        return False
    a, q = _once(a[len(lead) :]), _once(q)
    least = min(TILE_WORDS, len(q))
    if tileable(q, a, least) < share * len(a) - labelled or tileable(a, q, least) < share * len(q):
        return False
    got, in_tiles = copied(q, a)
    if got < share:
        return False
    left = np.flatnonzero(~in_tiles)
    runs = np.split(left, np.flatnonzero(np.diff(left) > 1) + 1) if len(left) else []
    beside = sum(len(r) for r in runs if not lead or [a[i] for i in r] != lead)
    return beside <= (1 - share) * len(a)


def _once(ws: list[str]) -> list[str]:
    """The words without their repetition, if they are one stretch again and again."""
    around = _period(ws)
    return ws[:around] if around * 2 <= len(ws) else ws


def tileable(a: list[str], b: list[str], least: int) -> int:
    """Words of b within some stretch of `least` words that a has too: no tiling covers more."""
    known = {tuple(a[i : i + least]) for i in range(len(a) - least + 1)}
    total = end = 0
    for j in range(len(b) - least + 1):
        if tuple(b[j : j + least]) in known:
            total += j + least - max(j, end)
            end = j + least
    return total


# The grammar of refusals, by language. CORE declines; AROUND may stand beside it.
_DO = r"(?:answer|help|assist|aid|provide|discuss|respond|reply|comment|share|comply|go into|engage|talk about|speak (?:about|to)|give|disclose|do (?:that|this|so)|fulfil+|support|continue|offer|say|tell|address|process|complete|write|create|generate|make)"
CORE = (
    rf"\b(?:i|we)(?: am|'m| are|'re)? (?:sorry,? (?:but )?)?(?:really |simply |just |currently |therefore |respectfully )?(?:can ?not|can't|could not|couldn't|won't|will not|may not|must not|do not|don't|am not|are not|'m not|am unable|are unable|'m unable|unable)(?: be)?(?: able| going| allowed| permitted| willing| in a position| comfortable| authori[sz]ed| here| to)*(?: to)? {_DO}\b[^.!?;]*",
    rf"\b(?:i|we) (?:must|have to|need to|will|would|am going to|am afraid i must|'ll|'d)(?: respectfully| politely| kindly)? (?:rather not|decline|refuse|refrain|pass|abstain|turn (?:this|that|it) down)\b[^.!?;]*",
    rf"\b(?:i|we)(?:'d| would) (?:rather|prefer) not (?:to )?\w+[^.!?;]*",
    r"\b(?:i|we) (?:do not|don't|would not|wouldn't) feel (?:comfortable|able|right)\b[^.!?;]*",
    r"\b(?:i|we) (?:decline|refuse|refrain|pass)\b[^.!?;]*",
    r"\b(?:my|our|the|these|safety) (?:guidelines|rules|policies|policy|instructions|guardrails|programming)\b[^.!?;]*\b(?:not|prevent|forbid|prohibit|keep|stop|n't)\b[^.!?;]*",
    r"\b(?:this|that|the|your|it)(?: (?:request|question|topic|subject|matter|task))? (?:is|falls|lies|goes|sits|would be)(?: well)? (?:outside|beyond|against|out of)\b[^.!?;]*\b(?:i|we|my|our|scope|guidelines|policy|policies)\b[^.!?;]*",
    r"\b(?:this|that|it)(?: (?:is|'s)| would be)? (?:not|n't) (?:something|a (?:topic|subject|matter|request)|anything) (?:that )?(?:i|we)(?:'m| am| are| can| may| could)\b[^.!?;]*",
    rf"\bit (?:would not|wouldn't|is not|isn't) be? ?(?:appropriate|right|proper|responsible|safe|possible) for (?:me|us) to\b[^.!?;]*",
    rf"\bno (?:answer|response|reply|information|comment|help|assistance) (?:can|could|will|may) be (?:given|provided|made|offered|shared)\b[^.!?;]*",
    r"\bas an? (?:ai|assistant|language model|ai (?:assistant|model|language model))\b[^.!?;]*\b(?:can(?:not|'t| not)|unable|not able|won't|must decline|rather not)\b[^.!?;]*",
    r"\b(?:ich|wir)\b[^.!?;]*\b(?:kann|darf|m[oö]chte|werde|k[oö]nnen|d[uü]rfen|bin)\b[^.!?;]*\b(?:nicht|keine?|leider|au[sß]er ?stande)\b[^.!?;]*\b(?:helfen|beantworten|antworten|auskunft|sagen|geben|[aä]u[sß]ern|unterst[uü]tzen|weiterhelfen|dienen|besprechen|eingehen|nachkommen)\b[^.!?;]*",
    r"\b(?:dabei|dazu|damit|darauf|daf[uü]r|hierbei|hierzu|diese[nrs]? \w+|da)\b[^.!?;]*\b(?:kann|darf|m[oö]chte|werde)\b (?:ich|wir)\b[^.!?;]*\b(?:nicht|keine?)\b[^.!?;]*",
    r"\b(?:ich|wir) (?:muss|m[uü]ssen|m[oö]chte|werde)\b[^.!?;]*\b(?:ablehnen|verweigern|passen|zur[uü]ckweisen)\b[^.!?;]*",
    r"\b(?:es ist mir|mir ist es|das ist mir) nicht (?:m[oö]glich|erlaubt|gestattet)\b[^.!?;]*",
    r"\b(?:je|nous)\b[^.!?;]*\b(?:ne|n')? ?(?:peux|puis|pouvons|suis|sommes|dois|devons|veux|souhaite|pr[eé]f[eè]re)\b[^.!?;]*\b(?:aider|r[eé]pondre|refuser|d[eé]cliner|fournir|discuter|commenter|parler|donner|traiter|mesure|autoris[eé]e?)\b[^.!?;]*",
    r"\bil (?:ne )?m'est (?:pas )?(?:impossible|permis|interdit|possible)\b[^.!?;]*",
    r"\bno (?:puedo|podemos|podr[eé]|me es posible|me est[aá] permitido|estoy autorizad[oa]|debo)\b[^.!?;]*\b(?:ayudar\w*|responder\w*|contestar\w*|proporcionar\w*|dar\w*|hablar|comentar\w*|discutir\w*|asistir\w*|facilitar\w*|ofrecer\w*)\b[^.!?;]*",
    r"\b(?:debo|tengo que|debemos|prefiero) (?:negarme|rechazar|declinar|abstenerme|no)\b[^.!?;]*",
    r"\bnon posso (?:aiutar\w*|rispondere|fornire|discutere)\b[^.!?;]*|\bdevo (?:rifiutare|declinare)\b[^.!?;]*|\bn[aã]o posso (?:ajudar|responder|fornecer|discutir)\b[^.!?;]*|\bdevo recusar\b[^.!?;]*",
)
AROUND = (
    r"(?:i'm|i am|we are|we're)?(?: so| very| really| truly)? ?sorry\b[^.!?;]{0,60}", r"unfortunately", r"thank(?:s| you)\b[^.!?;]{0,40}", r"(?:i|we) (?:appreciate|understand|see|know|hear)\b[^.!?;]{0,80}", r"however|but|though|still", r"let me be (?:clear|honest|frank)",
    r"as an? (?:ai |helpful )?(?:assistant|ai|model|language model)", r"hm+\b[^.!?;:]{0,40}|well|okay|ok|oh|alas|regrettably|apologies\b[^.!?;]{0,40}|i apologi[sz]e\b[^.!?;]{0,60}", r"[^.!?;]{0,60}\b(?:fair|good|great|interesting|reasonable|understandable|valid) (?:thing|question|point|request|one)\b[^.!?;]{0,40}",
    r"(?:please|kindly|feel free|you (?:may|might|could|can)|try|perhaps|maybe)\b[^.!?;]{0,30}\b(?:ask|contact|consult|try|reach|rephrase|choose|seek|speak|refer|see|provide)\b[^.!?;]{0,80}", r"(?:is there|do you have|can i|may i|would you|what else|anything|let me know|how else)\b[^.!?;]{0,90}", r"(?:even|especially|not) (?:for|about|in|if|when)\b[^.!?;]{0,40}", r"for (?:safety|legal|policy|privacy|security)\b[^.!?;]{0,30}",
    r"(?:es tut mir(?: sehr)? leid|leider|entschuldigung|verzeihung|bedauerlicherweise|danke\b[^.!?;]{0,40}|bitte\b[^.!?;]{0,80}|aber|jedoch)", r"(?:je suis|nous sommes)? ?d[eé]sol[eé]e?s?|malheureusement|pardon|merci\b[^.!?;]{0,40}|(?:veuillez|posez|merci de|n'h[eé]sitez)\b[^.!?;]{0,80}|s'il vous pla[iî]t|mais",
    r"lo (?:siento|lamento)\b[^.!?;,]{0,30}|por desgracia|desafortunadamente|lamentablemente|perd[oó]n|gracias\b[^.!?;]{0,40}|(?:haga|pregunte|por favor|consulte|intente)\b[^.!?;]{0,80}|pero|mi dispiace|purtroppo|desculpe|infelizmente",
)
# For further languages, what a declining clause holds: who can't, won't or mayn't, and what is asked for, in any order.
DECLINES = (
    (r"\b(?:ich|wir|mir|uns)\b", r"\b(?:kann|k[oö]nnen|darf|d[uü]rfen|m[oö]chte|m[oö]chten|werde|werden|bin|sind)\b[^.!?;]*\b(?:nicht|keine?n?|au[sß]er ?stande)\b", r"\b(?:helfen|weiterhelfen|beantworten|antworten|auskunft|[aä]u[sß]ern|unterst[uü]tzen|eingehen|nachkommen|behilflich)\b"),
    (r"\b(?:ik|wij|we|mij)\b", r"\b(?:kan|kunnen|mag|mogen|wil|zal|zullen|ben)\b[^.!?;]*\b(?:niet|geen)\b|\bmoet\b[^.!?;]*\bweigeren\b", r"\b(?:helpen|antwoord\w*|beantwoorden|ingaan|bespreken|verstrekken|weigeren|van dienst|meewerken)\b"),
    (r"\b(?:jag|vi|mig)\b", r"\b(?:kan|f[aå]r|vill|kommer|[aä]r)\b[^.!?;]*\b(?:inte|ingen)\b|\b(?:m[aå]ste|f[aå]r)\b[^.!?;]*\b(?:avst[aå]|avb[oö]ja)\b", r"\b(?:hj[aä]lpa|svara|besvara|diskutera|bist[aå]|uttala|l[aä]mna|st[aå] till tj[aä]nst|avst[aå]r?|avb[oö]ja)\b"),
    (r"", r"\bnie (?:mog[eę]|mo[zż]emy|jestem w stanie|wolno mi|b[eę]d[eę])|\bmusz[eę] odm[oó]wi[cć]|\bodmawiam", r"\b(?:pom[oó]c|pomaga[cć]|odpowiedzie[cć]|odpowiada[cć]|udzieli[cć]|udziela[cć]|poda[cć]|omawia[cć]|odm[oó]wi[cć]|odmawiam)\b"),
    (r"", r"\bне (?:могу|можем|в состоянии|имею права|буду|вправе|могла? бы|смогу)|\b(?:вынужден\w*|должн\w*) (?:отказать\w*|отклонить)|\bотказываюсь", r"\b(?:помочь|помогать|ответить|отвечать|обсуждать|предоставить|комментировать|дать|сказать|отказать\w*|отказываюсь|отклонить)"),
    (r"", r"\bnon (?:posso|possiamo|sono in grado|mi è (?:possibile|permesso|consentito)|sono autorizzat[oa])|\bdevo (?:rifiutar\w*|declinare)|\bmi rifiuto", r"\b(?:aiutar\w*|risponder\w*|fornir\w*|discuter\w*|assister\w*|dare|commentare|rifiutar\w*|declinare|rifiuto)\b"),
    (r"", r"\bn[aã]o (?:posso|podemos|consigo|estou autorizad[oa]|me é (?:poss[ií]vel|permitido)|sou capaz)|\b(?:devo|tenho que) (?:recusar|declinar)|\brecuso", r"\b(?:ajudar\w*|responder\w*|fornecer\w*|discutir\w*|auxiliar\w*|dar|comentar|recusar|declinar|recuso)\b"),
    (r"", r"\bnemohu|\bnem[uů][zž]eme|\bnesm[ií]m|\bmus[ií]m odm[ií]tnout", r"\b(?:pomoci|pomoct|odpov[eě]d[eě]t|odpov[ií]dat|poskytnout|odm[ií]tnout)\b"),
    (r"", r"\bnu (?:pot|putem|am voie|[iî]mi este permis)|\btrebuie s[aă] refuz", r"\b(?:ajut\w*|r[aă]spund\w*|ofer\w*|discut\w*|refuz)\b"),
    (r"", r"(?:yard[ıi]mc[ıi] ol|yan[ıi]tlay|cevaplay|cevap ver)\w*(?:am[ıi]yorum|amam|emiyorum|emem|amay[ıi]z)", r""),
    (r"", r"(?:できません|できかねます|いたしかねます|致しかねます|お断り|控え(?:させて|ます))", r"(?:答え|回答|返答|お手伝い|手助け|助け|支援|対応|提供|お伝え|ご案内|お断り|控え)"),
    (r"", r"(?:无法|不能|不便|不可以|拒绝|無法)", r"(?:回答|帮助|提供|协助|讨论|答复|满足|幫助|拒绝)"),
    (r"", r"(?:수 없|드릴 수 없|어렵습니다|거절)", r"(?:답변|대답|도움|도와|제공|응답|거절)"),
)
#: Of those clauses each holds one of these words, or, where words aren't spaced or carry endings, of these parts.
_WORDS_OF_NO = frozenset(
    "nicht kein keine keinen keiner außerstande ausserstande stande niet geen weigeren inte ingen avstå avsta avstår avstar avböja avboja nie muszę musze odmawiam non devo rifiuto não nao tenho recuso "
    "nemohu nemůžeme nemuzeme nesmím nesmim musím musim nu trebuie не вынужден вынуждена вынуждены должен должна должны отказываюсь".split()
)
_PARTS_OF_NO = ("amiyorum", "emiyorum", "amayiz", "olamam", "veremem")
_PARTS_BEYOND = ("ıyorum", "iyorum", "amam", "emem", "amayız", "できません", "かねます", "お断り", "控え", "无法", "不能", "不便", "不可以", "拒绝", "無法", "수 없", "어렵", "거절")
_PUNCTUATED = str.maketrans(dict.fromkeys(".,;:!?()\"'’", " "))


def _holds_no(answer: str) -> bool:
    small = answer.lower()
    return not _WORDS_OF_NO.isdisjoint(small.translate(_PUNCTUATED).split()) or any(x in small for x in (_PARTS_OF_NO if answer.isascii() else _PARTS_BEYOND))


# Words with which a clause goes on to tell something after all.
_AFTER_ALL = re.compile(r"[,，、]?\s*(?:\b(?:aber|jedoch|sondern|maar|men|ale|но|однако|ma|però|mas|porém|však|dar|insă|însă|ama|fakat)\b|ですが|但是?|하지만)\s*")
_DECLINES = tuple(tuple(re.compile(x) for x in row) for row in DECLINES)
# Courtesies of those languages, which may stand in the same answer.
COURTESY = re.compile(
    r"\b(?:helaas|het spijt (?:me|ons)|sorry|bedankt|dank u|tyv[aä]rr|f[oö]rl[aå]t|ledsen|tack|niestety|przykro mi|przepraszam|dzi[eę]kuj[eę]|извините|к сожалению|простите|мне жаль|спасибо|извиняюсь|mi dispiace|purtroppo|grazie|spiacente|desculpe|lamento|infelizmente|obrigad[oa]|sinto muito|bohu[zž]el|omlouv[aá]m se|[iî]mi pare r[aă]u|din p[aă]cate|scuze|üzgünüm|maalesef|leider|bitte|entschuldigung)\b"
    r"|(?:申し訳(?:ございません|ありません)?|すみません|残念ながら|恐れ入りますが|抱歉|对不起|很遗憾|죄송합니다|유감)"
)
_CORE = re.compile("|".join(f"(?:{p})" for p in CORE))
_AROUND = re.compile("|".join(rf"(?:(?<!\w){p}(?!\w))" for p in AROUND))
_HINT = re.compile(
    r"\b(?:i|we|my|our|me|us|ich|wir|mir|je|j'|m'est|nous|puedo|podemos|debo|me|prefiero|posso|devo|no (?:answer|response|reply|information|comment|help|assistance)|guidelines|rules|polic(?:y|ies)|decline|dabei|dazu)\b", re.I
)
_LINE_END = re.compile(r"\s*[\r\n]+\s*")


def is_refusal(answer: str) -> bool:
    """It declines and says nothing else: courtesies, reasons and offers aside.

    What follows a clause that declines must not go on to answer ("I can't find a lower one, so 7 is least").
    A line's end ends a clause unless the sentence runs on: a small letter follows, or a word precedes after which none ends.
    """
    hint, elsewhere = _HINT.search(answer), _holds_no(answer)
    if not hint and not elsewhere:
        return False
    body = _ANSWER_LABEL.sub("", answer, count=1).replace("’", "'").strip()
    lines = _LINE_END.split(body)
    parts = [lines[0]]
    for before, line in zip(lines, lines[1:]):
        words = before.rsplit(None, 1)
        parts += [" " if line[:1].islower() or words and words[-1].casefold() in OPEN_WORDS else " ; ", line]
    low = " ".join("".join(parts).casefold().split())
    return bool(hint) and _declines(low) or elsewhere and _declines_otherwise(low)


_CLAUSES = re.compile(r"[.!?;。！？；]+")


def _declines_otherwise(low: str) -> bool:
    """Every clause declines, in a language of DECLINES, or is a courtesy or an offer; at least one declines."""
    declines, left = False, 0
    for clause in _CLAUSES.split(low):
        n = _size(clause)
        if not n:
            continue
        if any(all(x.search(clause) for x in row) for row in _DECLINES):
            turn = _AFTER_ALL.search(clause)
            rest = clause[turn.end() :] if turn else ""
            if _size(rest) >= 4 and not COURTESY.search(rest) and not _AROUND.search(rest):
                return False
            declines = True
        elif not COURTESY.search(clause) and not _AROUND.search(clause):
            left += n
    return declines and left <= 5


def _size(clause: str) -> int:
    """Words of a clause; where words aren't spaced, two signs count as one."""
    return sum(1 if ord(w[0]) < 0x2E80 else max(1, len(w) // 2) for w in _GREEN.findall(clause))


def _declines(low: str) -> bool:
    found = _CORE.search(low)
    if not found:
        return False
    rest = low
    for clause in (m for m in _CORE.finditer(low)):
        text = clause.group()
        cut = re.search(r",? (?:but|however|so|yet|while|although) (?!i\b|we\b|you\b|please)", text)
        if cut and len(normal_words(text[cut.end() :])) >= 4:
            return False
        rest = rest.replace(text, " . ", 1)
    left = _AROUND.sub(" ", rest)
    return len(_LETTERS_ONLY.findall(left)) + 2 * len(re.findall(r"\d+", left)) <= 5


@lru_cache(1)
def _word_weights() -> dict[str, tuple[tuple[str, float], ...]]:
    by: dict[str, set[str]] = {}
    for lang, ws in FUNCTION_WORDS.items():
        for w in ws.split():
            by.setdefault(w, set()).add(lang)
    return {w: tuple((x, 1.0 / len(langs)) for x in sorted(langs)) for w, langs in by.items()}


@lru_cache(4096)
def _script(c: str) -> str:
    name = unicodedata.name(c, "")
    for s in ("LATIN", "GREEK", "CYRILLIC", "HANGUL", "ARABIC", "HEBREW", "DEVANAGARI", "THAI"):
        if name.startswith(s):
            return s
    return "CJK" if name.startswith(("CJK", "HIRAGANA", "KATAKANA")) else name.split(" ")[0]


def main_script(text: str) -> str | None:
    """The script of most letters; None without letters."""
    if text.isascii():
        return "LATIN" if re.search("[A-Za-z]", text) else None
    counts = Counter(_script(c) for c in text if c.isalpha())
    return counts.most_common(1)[0][0] if counts else None


_QUOTED = re.compile(r"\"[^\"\n]*\"|“[^”]*”|„[^“”]*[“”]|«[^»]*»|`[^`]*`")


def language(text: str) -> str | None:
    """Language of a text; short ones, which recur as questions, are remembered."""
    return _short_language(text) if len(text) <= 1000 else _language(text)


def _language(text: str) -> str | None:
    """A language of FUNCTION_WORDS or a script other than Latin; None if the text tells too little. Quotations don't count."""
    text = _QUOTED.sub(" ", text)
    script = main_script(text)
    if script != "LATIN":
        return script
    weights, scores = _word_weights(), dict.fromkeys(FUNCTION_WORDS, 0.0)
    for w in _LETTERS_ONLY.findall(text.replace("’", "'").casefold()):
        hits = weights.get(w)
        if hits is None and "'" in w:
            head, tail = w.split("'", 1)
            if head in ("l", "d", "c", "j", "n", "s", "m", "qu", "jusqu"):
                hits = (("fr", 0.5), ("it", 0.3 if head in ("l", "d", "c") else 0.0))
            elif tail in ("s", "t", "re", "ve", "ll", "d", "m"):
                hits = (("en", 1.0),)
        for lang, x in hits or ():
            scores[lang] += x
    if not text.isascii():
        low = text.casefold()
        for lang, letters in LETTERS.items():
            scores[lang] += 0.4 * min(3, sum(low.count(c) for c in letters))
    (best, top), (_, second) = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:2]
    return best if top >= 0.9 and top >= 1.25 * second else None


_short_language = lru_cache(20_000)(_language)
_ASKED = {lang: re.compile(rf"\b(?:{names})\b", re.I) for lang, names in LANGUAGE_NAMES.items()}
_ASKS = re.compile("|".join(LANGUAGE_NAMES.values()), re.I)


def in_other_language(question: str | None, answer: str) -> bool:
    """The whole answer, a label aside, is in another language than the question, which didn't ask for it."""
    if not question:
        return False
    body = _ANSWER_LABEL.sub("", answer, count=1)
    if len(body) < 3 or body.lstrip()[:1] in "{[" or body.lstrip().startswith("```"):
        return False
    got = language(body)
    if got is None:
        return False
    if got.isupper() and main_script(question) != got:
        return not (_ASKS.search(question) and _ASKED.get(got) and _ASKED[got].search(question))
    want = language(question)
    if want is None or want == got:
        return False
    return not (_ASKS.search(question) and _ASKED[got].search(question))


_PAIRS = {"(": ")", "[": "]", "{": "}", "“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "（": "）"}
_CLOSERS = frozenset("".join(_PAIRS.values()))
# Elements of markup, those that need no end, and wrappers that answers are asked for in.
_VOID = frozenset("br hr img input li p td th tr meta link area base col source wbr option".split())
_ELEMENTS = _VOID | frozenset("a abbr article aside b blockquote body button caption center cite code dd del details div dl dt em fieldset figure font footer form h1 h2 h3 h4 h5 h6 head header html i iframe ins kbd label legend main mark nav ol pre q s samp script section select small span strong style sub summary sup svg table tbody textarea tfoot thead title tt u ul var video".split())
_WRAPPERS = frozenset("answer response output result reply completion assistant thinking reasoning solution final document xml json".split())
_LAST_MARK = re.compile(r"^[ \t>]*(?:[-*•+]|\d{1,3}[.)]|[a-z][.)]|#{1,6})[ \t]*$")
#: A text without any of these has no structure to leave open.
_STRUCTURED = re.compile(r"[(\[{\"“„«「『（`<|*~\n]")
_SEPARATOR = re.compile(r"^\s*\|?\s*:?-{2,}:?\s*(?:\|\s*:?-*:?\s*)*\|?\s*$")
_NAMED = _ELEMENTS | _WRAPPERS
_MARKUP = re.compile(r"<(/?)([A-Za-z][\w:-]*)((?:\s[^<>]*)?/?)>|<(/?)([A-Za-z][\w:-]*)(\s[^<>]*)?$")
_EMOTICON = re.compile(r"[:;=]['’]?[-o^]?[()]+(?!\w)")
_INTERVAL = re.compile(r"[(\[\]]\s*[-+−]?[\w.∞]+\s*[,;]\s*[-+−]?[\w.∞]+\s*[)\]\[]")
_FENCE = re.compile(r"[ \t>]*(?:[-*+]\s+|\d+[.)]\s+)?(`{3,}|~{3,})(.*)")


def unfinished_structure(text: str) -> bool:
    """Whether a pushdown parse of fences, code marks, brackets, quotations, markup, emphasis, lists and tables ends with one open.

    The stack holds what must still be closed; a closing sign closes what was opened last of its kind and all
    that stands above it, and one without its opening is passed over. Code marks and emphasis end with their
    paragraph at the latest, so only those of the last one can be open; emphasis opens before a word only and
    not within one. A tag counts if it is an element of markup, a wrapper of answers, or closed later on;
    other words in angle brackets are text. Emoticons and intervals are signs of their own. Within fences and
    code marks nothing else counts.
    """
    if not _STRUCTURED.search(text):
        return False
    text = text.rstrip()
    lines = text.split("\n")
    data = text.lstrip()[:1] in ("{", "[")
    ends = frozenset(x.lower() for x in re.findall(r"</([A-Za-z][\w:-]*)\s*>", text)) if "</" in text else frozenset()
    stack: list[str] = []
    fence = ""
    for number, line in enumerate(lines):
        mark = _FENCE.match(line) if "```" in line or "~~~" in line else None
        if fence:
            if mark and mark.group(1).startswith(fence) and not mark.group(2).strip():
                del stack[_last(stack, fence) :]
                fence = ""
            continue
        if mark and "`" not in mark.group(2):
            fence = mark.group(1)
            stack.append(fence)
            continue
        if not line.strip():
            stack = [x for x in stack if x[0] not in "`*"]
        _parse_line(line, stack, data, ends, number == len(lines) - 1)
    if stack:
        return True
    last = lines[-1]
    if _LAST_MARK.match(last) and len(lines) > 1:
        return True
    if last.lstrip().startswith("|"):
        rows = [x for x in lines if x.lstrip().startswith("|")]
        if not last.rstrip().endswith("|") or last.count("|") < rows[0].count("|") or _SEPARATOR.match(last) or len(rows) == 1 and len(lines) == 1:
            return True
        cells = last.strip().strip("|").split("|")
        return len(cells) == rows[0].strip().strip("|").count("|") + 1 and not cells[-1].strip() and len(cells) > 1
    return False


def _last(stack: list[str], what: str) -> int:
    return len(stack) - 1 - stack[::-1].index(what)


_SIGNS = re.compile(r"[()\[\]{}“”„«»「」『』（）\"`<*\\:;=]")


def _parse_line(line: str, stack: list[str], data: bool, ends: frozenset[str], is_last: bool) -> None:
    i, n = 0, len(line)
    while i < n:
        m = _SIGNS.search(line, i)
        if not m:
            return
        i, c = m.start(), m.group()
        before, after = line[i - 1] if i else " ", line[i + 1] if i + 1 < n else " "
        if stack and stack[-1][0] == "`":  # within code marks
            run = re.compile("`+").search(line, i) if c == "`" else None
            if run and len(run.group()) == len(stack[-1]):
                stack.pop()
            i = run.end() if run else i + 1
            continue
        if c == "`":
            run = re.compile("`+").match(line, i)
            stack.append(run.group())
            i = run.end()
            continue
        if c == "\\":
            i += 2 if data or after in "()[]{}\"`*<" else 1
            continue
        if c == '"':
            if '"' in stack:
                del stack[_last(stack, '"') :]
            elif data or not before.isalnum():
                stack.append('"')
            i += 1
            continue
        if data and '"' in stack:  # a string of data
            i += 1
            continue
        if c in ":;=":
            face = _EMOTICON.match(line, i) if not data and before.isspace() else None
            i = face.end() if face else i + 1
            continue
        if c in "([]":
            interval = _INTERVAL.match(line, i)
            if interval and interval.group()[-1] != _PAIRS.get(c):
                i = interval.end()
                continue
        if c == "<":
            tag = _MARKUP.match(line, i)
            if not tag:
                i += 1
                continue
            name, beside = (tag.group(2) or tag.group(5) or "").lower(), before.isalnum()
            if tag.group(2) is None:  # the line ends within it
                if is_last and not beside and (tag.group(4) or any(x.startswith(name) for x in _NAMED | ends) if not tag.group(6) else name in _NAMED | ends):
                    stack.append("<")
                return
            if tag.group(1):
                if "<" + name in stack:
                    del stack[_last(stack, "<" + name) :]
            elif name in ends or name in _NAMED and not beside and _ATTRIBUTES.match(tag.group()):
                if name not in _VOID and not tag.group(3).rstrip().endswith("/"):
                    stack.append("<" + name)
            i = tag.end()
            continue
        if c == "*":
            if line.startswith("**", i):
                here = line[i + 2] if i + 2 < n else " "
                if "**" in stack and not before.isspace():
                    del stack[_last(stack, "**") :]
                elif (here.isalnum() or here in "\"“„«`([_") and not before.isalnum() and before not in "*/":
                    stack.append("**")
                while i < n and line[i] == "*":
                    i += 1
                continue
            i += 1
            continue
        if c in _PAIRS and not (c == "“" and "„" in stack) and not (before == after and before in "'’\"`"):
            stack.append(c)
        elif c in _CLOSERS:
            for k in range(len(stack) - 1, -1, -1):
                if c in _PAIRS.get(stack[k], ""):
                    del stack[k:]
                    break
        i += 1


_ENDED = re.compile(r"[.!?。！？…‽؟।]['\"”»’)\]}*_`」』）]*$")
_BREAKS = re.compile(r"[,;:–—/&(\[{<=+@#$\\-]$|\b(?:e\.g|i\.e|z\.B|etc,|p\.ex)\.?$", re.I)
_TOKEN = re.compile(r"\d[\d.,:/-]*\d|\d|[^\W\d_]+(?:['’-][^\W\d_]+)*|[.!?。！？…\n]+|[^\s\w]")
#: In place of a last word after which no sentence ends; up to so many words an answer may be no sentence at all.
OPEN, PHRASE_WORDS = "\u0002", 3
_STOPS = frozenset(".!?。！？…\n")


def _shape(token: str, first: bool) -> str:
    if token[0].isdigit():
        return "#"
    return "^" if token[0].isupper() and not first else token.lower()


def tail(text: str) -> tuple[str, str, int] | None:
    """(shape of the last word but one, last word, words) of a text that doesn't end in a full stop; None if it does."""
    line = text.rstrip().rstrip("*_ ")
    if not line or _ENDED.search(line):
        return None
    tokens = _TOKEN.findall(line.split("\n")[-1])
    words = [t for t in tokens if t[0].isalnum()]
    if not words or not tokens[-1][0].isalnum():
        return None
    last = words[-1]
    if last.lower() in OPEN_WORDS and last[0].islower() or len(words) > 1 and last.isupper() and text.isupper() and last.lower() in OPEN_WORDS:
        return "", OPEN, len(words)
    prev = _shape(tokens[-2], len(tokens) == 2 or tokens[-3][0] in _STOPS if len(tokens) > 2 else True) if len(tokens) > 1 and tokens[-2][0].isalnum() else ""
    return prev, "#" if last[0].isdigit() else last.lower(), len(words)


class _Tokens(dict):
    """token -> (1 word, 2 sentence end, 0 other; its form; whether it is capitalised); emptied when it has grown large."""

    def __missing__(self, token: str) -> tuple[int, str, bool]:
        if len(self) > 300_000:
            self.clear()
        c = token[0]
        got = self[token] = (1, "#" if c.isdigit() else token.lower(), c.isupper()) if c.isalnum() else (2 if c in _STOPS else 0, "", False)
        return got


_TOKENS = _Tokens()


def count_tails(texts: list[str | None], ends: Counter, goes_on: Counter) -> None:
    """Adds how often each word, after the one before it in its clause, ends a sentence and how often it goes on."""
    for text in texts:
        before, word, capital, first = "", None, False, True
        for kind, form, upper in map(_TOKENS.__getitem__, _TOKEN.findall(text.rstrip()) if text else ()):
            if kind == 1:
                if word is None:
                    before = ""
                else:
                    goes_on[before, word] += 1
                    before = "^" if capital else word
                word, capital, first = form, upper and not first, False
            else:
                if word is not None and kind == 2:
                    ends[before, word] += 1
                word, first = None, kind == 2


def judge(question: str | None, answer: str | None) -> tuple[str | None, tuple[str, str, int] | None]:
    """(defect, tail): what the pair alone shows, else the tail whose completeness the corpus decides."""
    if is_empty(answer):
        return "empty", None
    if is_copy(question, answer):
        return "copy", None
    if is_refusal(answer):
        return "refusal", None
    text = answer.rstrip()
    end = text.rstrip("*_ ")
    if unfinished_structure(text) or _BREAKS.search(end[-16:]):  # what it looks for is shorter
        return "truncated", None
    last = tail(text)
    if last and last[1] == OPEN:
        return "truncated", None
    if last and last[2] <= PHRASE_WORDS and "\n" not in text and not re.search(r"[.!?] ", text):
        last = ("", last[1], last[2])
    if in_other_language(question, answer):
        return "language", last
    return None, last


_SCAN_DDL = "kind string, pair_table string, pair_id string, defect string, prev string, word string, words int, ends bigint, goes_on bigint"
_SCAN = pa.schema([("kind", pa.string()), ("pair_table", pa.string()), ("pair_id", pa.string()), ("defect", pa.string()), ("prev", pa.string()), ("word", pa.string()), ("words", pa.int32()), ("ends", pa.int64()), ("goes_on", pa.int64())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends, goes_on = Counter(), Counter()

    def flush() -> pa.RecordBatch:
        rows = [("tail", None, None, None, *k, None, ends[k], goes_on[k]) for k in ends.keys() | goes_on.keys()]
        ends.clear()
        goes_on.clear()
        return _batch(rows)

    for b in batches:
        tables, ids, questions, answers = (b.column(i).to_pylist() for i in range(4))
        rows = []
        for t, i, q, a in zip(tables, ids, questions, answers):
            defect, last = judge(q, a)
            if defect or last:
                rows.append(("pair", t, i, defect, *(last or (None, None, None)), None, None))
        count_tails(answers, ends, goes_on)
        yield _batch(rows)
        if len(ends) + len(goes_on) > 400_000:
            yield flush()
    yield flush()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCAN)] if rows else [pa.array([], f.type) for f in _SCAN], schema=_SCAN)


def broken_pairs(pairs: DataFrame, least_seen: int = 5, end_share: float = 0.02) -> DataFrame:
    """(pair_table, pair_id, defect): the broken ones of pairs (pair_table, pair_id, question, answer), each once.

    One pass over whole texts judges every pair by itself: stand-ins and wrappers (empty), greedy string
    tiling with the question (copy: tiles cover both sides, in any order), a grammar of refusals, function
    words and scripts (language), and a pushdown parse of fences, code marks, brackets, quotations, markup,
    emphasis, lists and tables together with words and signs after which no sentence ends (truncated). The same pass counts over all answers how often each word,
    alone and after its predecessor, ends a sentence or goes on. An answer without full stop whose last words
    are seen at least least_seen times, but end a sentence in less than end_share of them, broke off; so did
    one whose last word is no word of the corpus but the beginning of one: seen at most once, or never at an
    end and a hundred times less than the longer word (misspellings are seen now and then).

    The counts are aggregated in each task before they are shuffled, and joined only to the few answers
    without full stop; a word on which a large share of them end is joined in salted tasks.
    Defined results: a null answer is empty; with a null or empty question neither copy nor language is
    judged; copies of a pair give one row, and with differing copies the first defect in DEFECTS; pairs
    without id are left out; empty tables give no row.
    """
    found = materialize(pairs.select("pair_table", "pair_id", "question", "answer").where("pair_id is not null").mapInArrow(_scan, _SCAN_DDL), "pairs")
    counted = found.where("kind = 'tail'").groupBy("prev", "word").agg(F.sum("ends").alias("ends"), F.sum("goes_on").alias("goes_on"))
    open_ = found.where("kind = 'pair' and defect is null").select("pair_table", "pair_id", "prev", "word", "words")
    tails = open_.groupBy("prev", "word").agg(F.count(F.lit(1)).alias("n"))
    alone = counted.groupBy("word").agg(F.sum("ends").alias("ends"), F.sum("goes_on").alias("goes_on"))
    wanted = tails.select("word").distinct()
    lengths = F.sequence(F.lit(1), F.length("word") - 1)
    longer = (
        alone.where(F.length("word") > 1)
        .select(F.explode(F.transform(lengths, lambda i: F.substring("word", 1, i))).alias("w"), (F.col("ends") + F.col("goes_on")).alias("n"))
        .join(wanted.withColumnRenamed("word", "w"), "w", "left_semi")
        .groupBy("w")
        .agg(F.max("n").alias("longer"))
        .withColumnRenamed("w", "word")
    )
    facts = (
        tails.drop("n")
        .join(counted, ["prev", "word"], "left")
        .join(alone.toDF("word", "ends1", "goes_on1"), "word", "left")
        .join(longer, "word", "left")
        .na.fill(0)
        .withColumn("t", F.struct("prev", "word"))
    )
    seen2, seen1 = F.col("ends") + F.col("goes_on"), F.col("ends1") + F.col("goes_on1")
    broke = (
        F.when((F.col("longer") >= least_seen) & ((seen1 < 2) | (F.col("ends1") == 0) & (seen1 * 100 <= F.col("longer"))), True)
        .when((F.col("prev") != "") & (seen2 >= least_seen), F.col("ends") < end_share * seen2)
        .when((F.col("prev") != "") & (seen1 >= least_seen), F.col("ends1") < end_share * seen1)
        .otherwise(False)
    )
    verdict = facts.select("t", "ends1", broke.alias("broke"))
    joined = salted_join(open_.withColumn("t", F.struct("prev", "word")), verdict, "t", "inner", hot_keys(tails.select(F.struct("prev", "word").alias("t"), "n"), "t"), [F.col("pair_id")])
    cut = joined.where("broke").select("pair_table", "pair_id", F.lit("truncated").alias("defect"))
    rank = F.array_position(F.array(*(F.lit(d) for d in DEFECTS)), F.col("defect"))
    return (
        found.where("kind = 'pair' and defect is not null").select("pair_table", "pair_id", "defect")
        .unionByName(cut)
        .groupBy("pair_table", "pair_id")
        .agg(F.min_by("defect", rank).alias("defect"))
    )
