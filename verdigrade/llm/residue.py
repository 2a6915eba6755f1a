"""Template residue: unfilled placeholders, filler text, error pages and script notices."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigrade.operators.skew import hot_keys, salted_join
from verdigrade.session import materialize

# How template languages mark a slot. STRONG marks nothing else; WEAK also occurs in prose and markup.
STRONG = (
    r"\{\{(?=[^{}\n]*\w)(?:[^{}\n]|\{[^{}\n]*\})+\}?\}\}",  # {{ name }}, with filters, calls and arguments
    r"\{%[-+]?\s*\w(?:[^%\n]|%(?!\}))*%\}",  # {% if name %}
    r"<%[=-]?\s*\w(?:[^%\n]|%(?!>))*%>",  # <%= name %>
    r"[$#]\{\s*[\w.:-]+\s*\}",  # ${name} #{name}
    r"%\(\w+\)[sdrfi]",  # %(name)s
    r"<<\s*[A-Za-z][\w .-]*>>",  # <<name>>
    r"\[\[\s*[A-Za-z][\w .-]*\]\]",  # [[name]]
    r"@@\s*[A-Za-z][\w .-]*@@",  # @@name@@
    r"(?<!\w)__[A-Z][A-Z0-9_]+?__(?!\w)",  # __NAME__
    r"(?<!\w)XX_[A-Z0-9_]+?_XX(?!\w)",  # XX_NAME_XX
    r"\[\s*(?i:insert|your|enter|add|put|type|fill in|replace(?: with)?|placeholder|tbd|todo)\b[^\]\[\n]*\]",  # [your name]
    r"<\s*(?i:insert|your|enter|add|put|type|fill in|placeholder)\b[^<>\n]*>",  # <your name>
)
WEAK = (
    r"(?<![\w$#{%])\{\s*[A-Za-z_][\w.-]*\s*\}(?!\})",  # {name}
    r"(?<![\w<])<[A-Za-z][\w-]*>(?!>)",  # <name>
    r"(?<![\w$])\$[A-Za-z_][A-Za-z0-9_]{2,}\b",  # $NAME
    r"(?<![\w%])%[A-Za-z_][\w-]+%(?!\w)",  # %NAME%
    r"\[[A-Za-z][A-Za-z_ -]+\](?![\[(:])",  # [Name]
    r"(?<!\w)_{3,}(?!\w)",  # a blank
    r"(?<!\w)(?:TBD|TODO|FIXME|TBA|XXX+)(?!\w)",  # a default
)
HTML_TAGS = frozenset(
    "a abbr article aside b body br button code details div em figure footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input "
    "label li link main meta nav noscript ol option p pre q s script section select small span strong style sub summary sup svg table tbody "
    "td textarea tfoot th thead title tr u ul video".split()
)
# The words of filler Latin.
LATIN = frozenset(
    "ad adipiscing adipisicing aliqua aliquip amet anim aute cillum commodo consectetur consequat culpa cupidatat deserunt do dolor dolore duis ea "
    "eiusmod elit enim esse est et eu ex excepteur exercitation fugiat id in incididunt ipsum irure labore laboris laborum lorem magna minim mollit "
    "nisi non nostrud nulla occaecat officia pariatur proident qui quis reprehenderit sed sint sit sunt tempor ullamco ut velit veniam voluptate".split()
)
LATIN_MARKS = frozenset(w for w in LATIN if len(w) >= 4)
_SCRIPT = r"(?:java ?-?scripts?|(?:client-side |browser )?script(?:s|ing)?|skripte?|scripts?)(?: (?:and|und|et|y) cookies)?"
# Labels of what pages say instead of content, each for a whole sentence: kind, words of which the sentence holds one, pattern.
# Without words a label is tried on every segment that isn't ASCII.
LABELS = (
    ("notice", "java javascript javascripts script scripts scripting skript skripte",
     rf"(?=[^.!?]*\b{_SCRIPT}\b)(?=[^.!?]*\b(?:enable|enabled|turn(?:ed)? on|switch(?:ed)? on|activate|allow|disabled|blocking|blocked|requires?|required|needs?|without|off|supported?)\b)"
     r"(?:(?:please|you|we|it|this|the|your|to|sorry|in order|for full|javascript|scripts?|enable|turn|switch|activate|allow)\b)[^.!?;]{5,}"),
    ("notice", "javascript skript skripte skripting script scripts guiones",
     r"(?=[^.!?]*\b(?:javascript|skripte?|skripting|scripts?|guiones)\b)(?=[^.!?]*\b(?:aktivier\w*|einschalt\w*|ben[oö]tigt|erforderlich|ohne|braucht|zulassen|blockier\w*|deaktivier\w*|activ\w*|d[eé]s?activ\w*|bloqu\w*|n[eé]cessite|requiert|n[eé]cesita|requiere|habilit\w*|permit\w*|autoris\w*|sans|sin|abilita\w*|attiva\w*|richiede|senza|ative|requer|sem|schakel|vereist|zonder|aktivera|kr[aä]vs|kr[aä]ver|w[lł][aą]cz\w*|wymaga\w*|включите|требуется|отключ\w*)\b)[^.!?;]{5,}"),
    ("notice", "", r"java ?script[^.!?。]*(?:有効|無効|必要|启用|禁用|需要|사용|활성)[^.!?。]*|[^.!?。]*(?:启用|请开启|활성화)[^.!?。]*java ?script[^.!?。]*"),
    ("error", "", r"(?:お探しの|ご指定の|指定された|要求された)?ページ[^。.!?]*(?:見つかりません|存在しません|表示できません)[^。.!?]*|アクセスが?(?:拒否|禁止)[^。.!?]*|(?:内部)?サーバー?(?:内部)?エラー[^。.!?]*|(?:しばらく|後で|時間をおいて)[^。.!?]*(?:お試し|再度)[^。.!?]*|(?:页面|网页|您?访问的页面)[^。.!?]*(?:不存在|未找到|找不到|无法)[^。.!?]*|找不到[^。.!?]*页面|访问被拒绝|服务器(?:内部)?错误|페이지를? 찾을 수 없[^.!?]*|접근이 거부[^.!?]*"),
    ("error", "", r"(?:запрошенная |эта )?страница[^.!?]*(?:не найдена|не существует|недоступна)|доступ (?:запрещ[её]н|закрыт)|(?:внутренняя )?ошибка(?: сервера)?(?: \d{3})?|сервер (?:временно )?(?:недоступен|не отвечает)|попробуйте[^.!?]*(?:позже|ещё раз|снова)|b[lł][aą]d(?: serwera)?(?: \d{3})?|(?:ta |[zż][aą]dana )?strona[^.!?]*(?:nie (?:istnieje|zosta[lł]a|jest dost[eę]pna))[^.!?]*|nie znaleziono strony|odmowa dost[eę]pu|spr[oó]buj[^.!?]*(?:ponownie|p[oó][zź]niej)[^.!?]*|[aå]tkomst nekad|p[aá]gina n[aã]o encontrada|acesso negado|a p[aá]gina[^.!?]*n[aã]o (?:existe|foi encontrada|est[aá])[^.!?]*"),
    ("error", "error http fehler erreur not forbidden bad unauthorized internal service gateway too gone proxy", r"(?:http |error |fehler |erreur )?[45]\d\d(?:[ :-]*(?:error|not found|forbidden|bad gateway|bad request|unauthorized|internal server error|service unavailable|gateway time-?out|too many requests|gone|proxy error))?"),
    ("error", "error fehler erreur fout errore erro fel", r"(?:error|fehler|erreur|fout|errore|erro|fel)(?: code)?[ :#]*\d{3}"),
    ("error", "found forbidden gateway error unavailable timeout time requests unauthorized denied timed expired oops whoops snag", r"(?:not found|forbidden|bad gateway|internal server error|service unavailable|gateway time-?out|too many requests|unauthorized|access denied|permission denied|page not found|request timed out|session expired|oops|whoops|we hit a snag)"),
    ("error", "verweigert gefunden abgelaufen refusé refuse introuvable expirée expiree denegado encontrada caducada servidor serveur serverfehler trovata negato scaduta gevonden geweigerd verlopen hittades serverfout",
     r"(?:zugriff verweigert|seite nicht gefunden|sitzung abgelaufen|acc[eè]s refus[eé]|page introuvable|session expir[eé]e|acceso denegado|p[aá]gina no encontrada|sesi[oó]n caducada|error del servidor|erreur du serveur|serverfehler|pagina non trovata|accesso negato|sessione scaduta|pagina niet gevonden|toegang geweigerd|sessie verlopen|sidan hittades inte|interne serverfout)"),
    ("error", "page report server gateway service site url address resource link file connection",
     r"(?:sorry,? |unfortunately,? )?(?:the|this|that) (?:requested |upstream |remote )?(?:page|report|server|gateway|service|site|url|address|resource|link|file|connection)\b(?: (?:you|that|at) [^.!?]{0,40}?)?(?: \w+)? "
     r"(?:(?:could not|cannot|can't|can not) be (?:found|located|loaded|opened|displayed|shown|reached)|was not found|(?:did not|does not|is not) (?:answer|answering|respond|responding|reply|exist|available)|(?:may|might) have been (?:moved|renamed|removed|deleted|changed)|(?:has been|was) (?:moved|removed|deleted|reset|closed|refused)|sent an invalid|returned an? (?:invalid|error|empty)|timed out|took too long|is no longer)\b[^.!?]{0,40}"),
    ("error", "down unavailable offline overloaded busy maintenance", r"(?:the|this) (?:page|server|service|site|gateway)(?: is)? (?:currently |temporarily )?(?:down|unavailable|offline|overloaded|busy|under maintenance)\b[^.!?]{0,60}"),
    ("error", "nothing", r"nothing (?:lives|exists|is|was found)\b[^.!?]{0,50}"),
    ("error", "wrong", r"something (?:went|has gone) wrong\b[^.!?]{0,70}"),
    ("error", "permission access authorized authorised allowed", r"you (?:do not|don't|are not|have no)\b[^.!?]{0,20}\b(?:permission|access|authori[sz]ed|allowed)\b[^.!?]{0,60}"),
    ("error", "session login request connection access ip", r"your (?:session|login|request|connection|browser session|access|ip)\b[^.!?]{0,20}\b(?:has|was|is|timed|could)\b[^.!?]{0,90}"),
    ("error", "try sign log reload refresh check", r"(?:please )?(?:try|sign in|log in|reload|refresh|check)\b[^.!?\d]{0,20}\b(?:again|later|the page|the address|the url)\b[^.!?]{0,40}"),
    ("error", "contact report let", r"if (?:this|the (?:problem|error|issue))\b[^.!?]{0,70}\b(?:contact|report|let us)\b[^.!?]{0,40}"),
    ("error", "could couldn having experiencing sorry can cannot", r"we (?:could not|couldn't|are having|are experiencing|are sorry|can't|cannot)\b[^.!?]{0,80}"),
    ("error", "seite dienst server sitzung anfrage zugriff adresse", r"(?:die|der|das|diese|ihre|ihr) (?:angeforderte |gesuchte )?(?:seite|dienst|server|sitzung|anfrage|zugriff|adresse)\b(?=[^.!?]*\b(?:gibt es|nicht (?:verf[uü]gbar|gefunden|erreichbar|mehr|erlaubt)|existiert nicht|abgelaufen|verweigert|blockiert|gesperrt|wartung|antwortet nicht|ung[uü]ltig))[^.!?]{0,100}"),
    ("error", "pagina página page service servicio serveur servidor session sesión sesion requête requete solicitud demande ressource recurso", r"(?:la|le|cette|votre|su|este|esta|el) (?:p[aá]gina|page|service|servicio|serveur|servidor|session|sesi[oó]n|requ[eê]te|solicitud|demande|ressource|recurso)\b(?=[^.!?]*\b(?:demand[eé]e|introuvable|n'existe|indisponible|expir[eé]|refus[eé]e?|bloqu[eé]e?|ne r[eé]pond|n'a pas|maintenance|solicitada|no existe|no est[aá]|no se|no responde|no respondi[oó]|caducado|expirado|bloquead[ao]|denegad[ao]|mantenimiento|inv[aá]lid[ao]|invalide))[^.!?]{0,100}"),
    ("error", "pagina sito server servizio sessione website sessie sidan sida servern servicen", r"(?:la|il|questa|questo|de|deze|uw|den|denna) ?(?:richiest[ao] |gevraagde |opgevraagde |beg[aä]rda )?(?:pagina|sito|server|servizio|sessione|website|sessie|sidan|sida|servern|servicen)\b(?=[^.!?]*\b(?:non (?:esiste|è|e|risponde|trovat[ao])|scadut[ao]|negat[ao]|niet (?:gevonden|bereikbaar|beschikbaar|worden)|bestaat niet|verlopen|geweigerd|hittas|finns inte|svarar inte|otillg[aä]nglig))[^.!?]{0,100}|sidan (?:kunde inte hittas|finns inte)[^.!?]{0,60}"),
    ("error", "errore fout misgegaan fel", r"si è verificato un errore[^.!?]{0,60}|er is (?:een fout opgetreden|iets (?:mis|fout)gegaan|iets misgegaan)[^.!?]{0,60}|(?:ett fel|n[aå]got gick fel)[^.!?]{0,60}"),
    ("error", "versuchen réessayer reessayer réessayez reessayez inténtelo intentelo riprova riprovare probeer prova försök", r"(?:bitte )?versuchen sie es\b[^.!?]{0,50}|(?:veuillez )?r[eé]essaye[rz]?\b[^.!?]{0,40}|(?:por favor,? )?int[eé]ntelo\b[^.!?]{0,40}|(?:si prega di )?riprova(?:re)?\b[^.!?]{0,40}|probeer het\b[^.!?]{0,40}|f[oö]rs[oö]k igen\b[^.!?]{0,40}"),
    # Sentences that stand in for text to come.
    ("filler", "text paragraph content copy sentence", r"(?:this is )?(?:a |an |some )?(?:dummy|sample|placeholder|filler|example|test) (?:text|paragraph|content|copy|sentence)\b(?:,? (?:goes|here|that|which|only|to be|will be|for now|until)\b[^.!?]{0,60})?"),
    ("filler", "insert type write replace enter add put fill paste describe", r"(?:insert|type|write|replace|enter|add|put|fill in|paste|describe) (?:\w+ ){0,6}(?:here|later|place|paragraph|section|box|field|text|publishing|below|above)\b.*"),
    ("filler", "copy content text details description", r"(?:body|more|main|full)? ?(?:copy|content|text|details|description) (?:to follow|coming soon|goes here|will follow|here|to come)\b.*"),
    ("filler", "heading title caption subtitle headline footer quote", r"(?:heading|title|caption|subtitle|headline|footer|quote)\b.{0,30}\b(?:here|goes below|goes here|below)\b.*"),
    ("filler", "soon", r"coming soon"),
    ("filler", "text texte texto inhalt", r"(?:hier|ici|aqu[ií])\b.{0,30}\b(?:text|texte|texto|inhalt)\b.*"),
    # What surrounds a page's text.
    ("furniture", "home menu help search sign log login logout contact imprint privacy terms cookie cookies about faq loading skip back go retry next previous share print close ok settings language subscribe rights",
     r"(?:home|menu|help|search(?: \w+)?|sign in|sign up|log ?in|log ?out|login|contact|imprint|privacy(?: policy)?|terms(?: of (?:use|service))?|cookie settings|accept cookies|cookies|about(?: us)?|faq|loading|skip to (?:main )?content|back to (?:the )?(?:start|home|top|front|previous)(?: ?page)?|go back|back|retry|next|previous|share|print|close|ok|settings|language|subscribe|all rights reserved)"),
    ("furniture", "reference trace request incident error ray id code", r"(?:reference(?: number)?|trace(?: id)?|request id|incident|error id|ray id|id|code)[ :#]+[\w-]{2,}"),
    ("furniture", "zur zurück zuruck startseite menü menu hilfe anmelden retour accueil aide volver inicio ayuda menú reintentar réessayer reessayer erneut indietro terug startpagina",
     r"(?:zur (?:startseite|[uü]bersicht)|zur[uü]ck(?: zur \w+)?|startseite|men[uü]|hilfe|anmelden|retour(?: [aà] l'accueil)?|accueil|aide|volver(?: al inicio)?|inicio|ayuda|men[uú]|reintentar|r[eé]essayer|erneut versuchen|torna (?:alla home|indietro)|indietro|terug(?: naar \w+)?|startpagina)"),
    ("furniture", "copyright c", r"(?:©|\(c\)|copyright)[^.!?]{0,60}"),
    ("furniture", "", r"©[^.!?]{0,60}"),
)
# Words of a sentence that tells of marks instead of holding an unfilled one.
TELLS = re.compile(
    r"\b(?:placeholders?|templates?|variables?|syntax|markup|(?:template|format) strings?|merge (?:tags?|fields?)|expands?|expanded|rendered|renders|substitut\w+|interpolat\w+|stands? for|is replaced|are replaced|be replaced|replaces|platzhalter|vorlagen?|variablen?|gabarits?|plantillas?|marcador\w*)\b"
    r"|^\W*(?:use|write|put|type|insert|add|replace|escape|mention)\s+\W?␣|[\"“„«‘']\s*␣\s*[\"”“»’']", re.I
)

_FENCE = re.compile(r"(?ms)^[ \t>]*(```+|~~~+).*?(?:^[ \t>]*\1[ \t]*$|\Z)")
_INLINE = re.compile(r"(`+)(?!`)[^\n]*?(?<!`)\1(?!`)|<(code|pre|kbd|samp)\b[^>]*>.*?</\2>", re.S)
_STRONG = re.compile("|".join(f"(?:{p})" for p in STRONG))
_WEAK = re.compile("|".join(f"(?:{p})" for p in WEAK))
_MARKERS = re.compile(r"[{$]|<[%<=\s-]*[A-Za-z]|%[(A-Za-z_]|@@|\[\s*[\[A-Za-z]|__|XX|TB|TODO|FIXME")
_VARIABLE = re.compile(r"\b[\w-]*\d[\w.-]*\b")
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>")
#: The same splits twice: the second begins with a set of signs, which is searched faster, and is for texts without 。！？.
_SPLIT_ANY = re.compile(r"\n+|(?<=[.!?…])\s+|(?<=[。！？])\s*|\s[-–—|•·]\s|^\s*[-*•]\s+", re.M)
_SPLIT = re.compile(r"[\s*•-](?:(?<=\n)\n*|(?<=[.!?…]\s)\s*|(?<=\s)[-–—|•·]\s|(?<=^\s)\s*[-*•]\s+|(?<=^[-*•])\s+)", re.M)
_WIDE_END = re.compile("[。！？]")
_END = r"(?=$|[\s.,:;!?…|)\]。！？、-])"
_KINDS = ("notice", "error", "filler", "furniture")
_BY_WORD: dict[str, list[int]] = {}
for _i, (_, _words, _pattern) in enumerate(LABELS):
    for _w in _words.split():
        _BY_WORD.setdefault(_w, []).append(_i)
_ANYWHERE = tuple(i for i, x in enumerate(LABELS) if not x[1])
_TELLING = frozenset(_BY_WORD) | LATIN_MARKS


@lru_cache(10_000)
def _label(kind: str, which: frozenset[int]) -> re.Pattern | None:
    """The labels of a kind among `which` as one pattern."""
    patterns = [LABELS[i][2] for i in sorted(which) if LABELS[i][0] == kind]
    return re.compile("|".join(f"(?:(?<!\\w){p}{_END})" for p in patterns), re.I) if patterns else None


_WORDS, _ASCII_WORDS = re.compile(r"[^\W\d_]+"), re.compile("[A-Za-z]+")
_STATUS = re.compile(r"(?<![\w.-])(?:40[013458]|410|429|50[0-4])(?![\w.-])")
_TOKEN = re.compile(r"\w+|[^\w\s]")
_LABEL_END = frozenset(":：=|>-–—")
#: Words of a title that isn't on a line of its own, and of a menu's entry.
TITLE_WORDS, MENU_WORDS = 6, 2
_MARGIN = " \t\r#>*_-|"
_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "qwertzuiop", "yxcvbnm", "azertyuiop")


def without_code(text: str) -> str:
    """The text with code blocks and code marks taken out; each leaves a mark that is no slot."""
    if "`" in text or "~~~" in text or "<code" in text or "<pre" in text:
        text = _INLINE.sub(" ␀ ", _FENCE.sub(" ␀ ", text))
    return text


def slots(body: str) -> Iterator[tuple[str, str, bool]]:
    """(template, filler, certain) of each line with marks of a slot; body: a text without code.

    template: the line with its marked slots and its variable words (numbers, names with digits) blanked,
    which aligns it with the lines of other records made from the same template.
    """
    if not _MARKERS.search(body):
        return
    for line in body.split("\n"):
        if not _MARKERS.search(line):
            continue
        strong = _STRONG.findall(line)
        rest = _STRONG.sub("␣", line)
        weak = [m for m in _WEAK.findall(rest) if not (m[0] == "<" and m.strip("<>").lower() in HTML_TAGS) and m.lower() not in ("[x]", "[ ]")]
        if not strong and not weak:
            continue
        template = _VARIABLE.sub("␣", _WEAK.sub("␣", rest))
        template = " ".join(template.casefold().split())
        yield template, "\u0001".join(strong + weak), bool(strong)


def fixed_parts(template: str) -> tuple[list[str], bool, str] | None:
    """(tokens, leads, pattern): the template's longest fixed part, whether lines begin with it, and what its lines match.

    Lines are matched as tokens joined by spaces. A value is any text; in prose it doesn't run over a sentence's
    end, after a label (a part that ends with a sign) it may. None: nothing fixed but a word of prose, to which
    any line could be aligned.
    """
    parts = [_TOKEN.findall(x) for x in template.split("␣")]
    letters = [sum(map(len, _WORDS.findall(" ".join(x)))) for x in parts]
    label = any(x and x[-1] in _LABEL_END and n for x, n in zip(parts[:-1], letters))
    label = label or bool(parts[-1]) and parts[-1][-1] in ",:;"  # Dear <name>,
    if sum(len(_WORDS.findall(" ".join(x))) for x in parts) < (1 if label else 2):
        return None
    at = letters.index(max(letters))
    tokens = parts[at]
    if at:
        tokens = tokens[next(i for i, x in enumerate(tokens) if _WORDS.search(x)) :]
    pattern = ""
    for i, x in enumerate(parts):
        if i:
            before = parts[i - 1]
            pattern += ".+" if before and before[-1] in _LABEL_END else "[^.!?]+"
        pattern += " ".join(["", *(re.sub(r"(\W)", r"\\\1", t) for t in x), ""])
    return tokens, at == 0, f"^{pattern}$"


def _hash(tokens: list[str], leads: bool) -> int:
    h = int(leads)
    for x in tokens:
        h = crc32(x.encode(), h)
    return h


def _holder(words: frozenset | None) -> Callable[[str], bool]:
    """Whether a casefolded text may hold one of words; None: it always may."""
    if words is None:
        return lambda low: True
    if len(words) <= 64 or "" in words:
        return lambda low: any(w in low for w in words)
    return lambda low: not words.isdisjoint(_WORDS.findall(low))


def _mashed(low: list[str]) -> bool:
    """Words typed for their look: one word again and again, or runs along the keyboard."""
    if len(low) < 2:
        return False
    if len(low) >= 3 and len(set(low)) <= len(low) * 0.6 and max(low.count(w) for w in set(low)) >= max(2, len(low) // 2):
        return True
    return sum(map(_TYPED.__getitem__, low)) * 2 >= len(low)


class _Typed(dict):
    """word -> whether it is one letter or a run along the keyboard; emptied when it has grown large."""

    def __missing__(self, word: str) -> bool:
        if len(self) > 100_000:
            self.clear()
        t = self[word] = len(word) > 2 and (len(set(word)) == 1 or any(word in r or word in r[::-1] for r in _ROWS))
        return t


_TYPED = _Typed()


def latin_share(low: list[str]) -> float:
    """Share of words of filler Latin, if a typical one is among them."""
    return sum(w in LATIN for w in low) / len(low) if low and any(w in LATIN_MARKS for w in low) else 0.0


def segment_kind(segment: str) -> str:
    """filler, notice, error, furniture or text; a message counts if next to nothing is said beside it."""
    ascii = segment.isascii()
    words = _ASCII_WORDS.findall(segment) if ascii else _WORDS.findall(segment)
    if not words:
        return "furniture"
    low = [w.casefold() for w in words]
    plain = _TELLING.isdisjoint(low)
    if not plain and latin_share(low) >= 0.8 or _mashed(low):
        return "filler"
    which = set() if plain else {i for w in low for i in _BY_WORD.get(w, ())}
    if not ascii:
        which.update(_ANYWHERE)
    if which:
        rest, kinds, key = segment, [], frozenset(which)
        for kind in _KINDS:
            pattern = _label(kind, key)
            cut = pattern.sub(" ", rest) if pattern else rest
            if cut != rest:
                rest, kinds = cut, [*kinds, kind]
        if kinds and len(_WORDS.findall(rest)) <= max(1, len(words) // 8):
            return kinds[0]
    menu = len(words) <= MENU_WORDS and segment[-1] not in ".!?:;," and not any(c.isdigit() or ord(c) > 0x2E7F for c in segment)
    return "furniture" if menu else "text"


def segments(body: str) -> Iterator[tuple[str, bool]]:
    """The sentences and lines of a text without code, and whether a line break follows."""
    body = body.replace("␀", " ")
    body, at = _TAG.sub(" ", body) if "<" in body else body, 0
    for m in (_SPLIT_ANY if not body.isascii() and _WIDE_END.search(body) else _SPLIT).finditer(body):
        s = body[at : m.start()].strip(_MARGIN)
        if s:
            yield s, "\n" in m.group()
        at = m.end()
    s = body[at:].strip(_MARGIN)
    if s:
        yield s, False


def is_title(segment: str, own_line: bool, first: bool, body: str) -> bool:
    """A text's first line, or the first few words of one, that end no sentence and leave something to come."""
    return first and segment[-1] not in ".!?。！？" and (own_line or len(_WORDS.findall(segment)) <= TITLE_WORDS) and len(segment) < len(body.strip()) - 4


def page(body: str) -> tuple[str | None, list[str] | None]:
    """(kind, unknown segments): kind is what a text without code consists of apart from title and furniture.

    unknown: aligned forms (variable words blanked) of the segments that no label fits; if there are any,
    kind is what the labelled ones are, and whether the text is a page of it rests on the unknown ones. None:
    the unknown segments are more than the labelled ones; only as a repeated page can this be one.
    """
    _, kind, unknown, _ = lead_and_page(body)
    return kind, unknown


def aligned(text: str) -> str:
    """The text with its variable words blanked."""
    return " ".join(_VARIABLE.sub("␣", text).casefold().split())


def lead_and_page(body: str) -> tuple[str | None, str | None, list[str] | None, int]:
    """What the text leads with ('error', 'notice' or 'filler' if a labelled message comes first, '404' if a title gives a status), its page, and how many segments are labelled."""
    lead, kind, unknown, known = None, None, [], 0
    parts = list(segments(body))
    for n, (s, own_line) in enumerate(parts):
        k = segment_kind(s)
        if k == "text":
            if is_title(s, own_line, not n, body):
                status = _STATUS.search(s)
                lead = status and status.group()
                continue
            unknown.append(s)
            if len(unknown) > known + len(parts) - n - 1:  # whatever the rest says, more are unknown
                return lead, None, None, known
        elif k != "furniture":
            kind, known = kind or k, known + 1
            lead = lead or (None if unknown else k)
    return lead, kind, list(dict.fromkeys(map(aligned, unknown))), known


#: Bits of the filters of fixed parts and of lines, and words of them beyond which texts aren't filtered by words; neither loses a line.
PART_BITS, MOST_WORDS = 1 << 21, 50_000
#: Tokens at the beginning of a fixed part by whose hash lines are found; the whole template is matched afterwards.
KEY_TOKENS = 8


def _schema(**types: str) -> tuple[pa.Schema, str]:
    arrow = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    return pa.schema([(n, arrow[t]) for n, t in types.items()]), ", ".join(f"{n} {t}" for n, t in types.items())


_PARTS, _PARTS_DDL = _schema(key="string", part="bigint", pattern="string", word="string", first="string", n_tokens="int")
_LINES, _LINES_DDL = _schema(key="string", h="bigint", word="string")
_OUT, _DDL = _schema(doc_id="bigint", kind="string", key="string", filler="string", known="boolean", n="int", digest="bigint")
_AGAIN, _AGAIN_DDL = _schema(kind="string", doc_id="bigint", key="string", part="bigint", line="string", n="int", digest="bigint")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def _digest(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _line_hash(key: str) -> int:
    return crc32(key.encode("utf-8", "surrogatepass"))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slots (known: its marks mark nothing else; n: whether the line tells of marks), pages, and lines to learn (n: segments unknown)."""
    for b in batches:
        rows = []
        for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if d is None or not t or not t.strip():
                continue
            body = without_code(t)
            digest = None
            for template, filler, certain in slots(body):
                digest = digest or _digest(t)
                rows.append((d, "slot", template, filler, certain, int(bool(TELLS.search(template))), digest))
            lead, kind, unknown, known = lead_and_page(body)
            if kind and not unknown:
                rows.append((d, kind, None, None, True, 0, 0))
                continue
            if lead:
                rows.append((d, "page", str(_digest(aligned(body))), lead, True, 0, digest or _digest(t)))
            if kind and len(unknown) <= known:
                rows.extend((d, "segment", k, kind, True, len(unknown), digest or _digest(t)) for k in unknown)
        yield _batch(rows, _OUT)


def _template_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(k, _hash(x[0][:KEY_TOKENS], x[1]), x[2], max(_WORDS.findall(" ".join(x[0])), key=len), x[0][0], min(len(x[0]), KEY_TOKENS)) for k in b.column(0).to_pylist() if (x := fixed_parts(k))]
        yield _batch(rows, _PARTS)


def _candidate_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield _batch([(k, _line_hash(k), max(_WORDS.findall(k), key=len, default="")) for k in b.column(0).to_pylist()], _LINES)


def _again(parts: tuple | None, lines: tuple | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a second reading of the documents yields for templates (bits, words, first words, most tokens) and for lines to learn (bits, words).

    'line': a line that holds the fixed part of some template (key: its own template if it is marked);
    'seen': a line that may be one of those to learn; 'page': such a line of a document that holds nothing
    else but labelled segments, title and furniture (n: how many such lines). All are found by words first,
    then by a filter of hash bits, which keeps too many at worst.
    """
    bits, words, firsts, longest = parts or ({}, frozenset(), frozenset(), 0)
    line_bits, line_words = lines or ({}, frozenset())
    may_fill, may_learn = _holder(words), _holder(line_words)

    def filled(body: str) -> Iterator[tuple[int, str, str]]:
        for line in body.split("\n"):
            if not may_fill(line.casefold()):
                continue
            marked = next(slots(line), None)
            key = marked[0] if marked else aligned(line)
            tokens, found = _TOKEN.findall(key), set()
            for i, first in enumerate(tokens):
                if firsts is not None and first not in firsts:
                    continue
                for leads in (True, False) if not i else (False,):
                    h = int(leads)
                    for x in tokens[i : i + longest]:
                        if x == "␣":
                            break
                        h = crc32(x.encode(), h)
                        if bits.get((h % PART_BITS) >> 5, 0) >> (h & 31) & 1:
                            found.add(h)
            for h in found:
                yield h, f" {' '.join(tokens)} ", key if marked else ""

    def learnable(body: str) -> tuple[set[str], set[str] | None]:
        """The lines of a text that may be to learn, and the same if the text is a page of them."""
        seen, rest, n = set(), False, 0
        for s, own_line in segments(body):
            if may_learn(s.casefold()):
                key = aligned(s)
                h = _line_hash(key)
                if line_bits.get((h % PART_BITS) >> 5, 0) >> (h & 31) & 1:
                    seen.add(key)
                    n += 1
                    continue
            if not rest:
                rest = segment_kind(s) == "text" and not is_title(s, own_line, not n, body)
            n += 1
        return seen, None if rest else seen

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if d is None or not t:
                    continue
                low = t.casefold()
                fill, learn = parts and may_fill(low), lines and may_learn(low)
                if not fill and not learn:
                    continue
                body, digest = without_code(t), _digest(t)
                if fill:
                    rows.extend(("line", None, key, part, line, None, digest) for part, line, key in filled(body))
                if learn:
                    seen, page_of = learnable(body)
                    rows.extend(("seen", None, k, None, None, None, digest) for k in seen)
                    rows.extend(("page", d, k, None, None, len(page_of), digest) for k in page_of or ())
            yield _batch(rows, _AGAIN)

    return run


def _bits(hashes: DataFrame, h: str) -> dict[int, int]:
    """The filter of PART_BITS bits with those of the hashes set, 32 of them an entry."""
    at = F.shiftright(F.pmod(h, F.lit(PART_BITS)), 5).cast("int")
    return {r[0]: r[1] & 0xFFFFFFFF for r in hashes.groupBy(at).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod({h}, 32) as int))"))).collect()}


def _few(words: DataFrame) -> frozenset | None:
    """The distinct words, or None if they are more than MOST_WORDS."""
    got = words.distinct().limit(MOST_WORDS + 1).collect()
    return frozenset(r[0] for r in got) if len(got) <= MOST_WORDS else None


def read_again(docs: DataFrame, templates: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One more reading of docs (id, text) for templates (key) and candidate lines (key).

    Comes out as: (key, s0, s1), the least and greatest digest of the texts that hold a line of the template
    with other values; (key, n_texts), the number of different texts of all in which a candidate stands;
    (doc_id, key, n), the documents that consist of n candidate lines besides what is labelled.
    Template lines are found by the hash of the template's longest fixed part and matched with the whole
    template. What the driver collects is bounded: the filters' bits and words.
    """
    parts = materialize(templates.mapInArrow(_template_parts, _PARTS_DDL), "template-parts")
    lines = materialize(candidates.mapInArrow(_candidate_words, _LINES_DDL), "candidate-lines")
    longest = parts.agg(F.max("n_tokens")).first()[0]
    of_parts = (_bits(parts, "part"), _few(parts.select("word")), _few(parts.select("first")), longest) if longest else None
    bits = _bits(lines, "h")
    of_lines = (bits, _few(lines.select("word"))) if bits else None
    read = docs if of_parts or of_lines else docs.limit(0)
    again = materialize(read.mapInArrow(_again(of_parts, of_lines), _AGAIN_DDL), "read-again")
    found = again.where("kind = 'line'").groupBy("part", "line", F.col("key").alias("template")).agg(F.min("digest").alias("s0"), F.max("digest").alias("s1"))
    hot = hot_keys(found.groupBy("part").agg(F.count(F.lit(1)).alias("n")), "part")
    both = salted_join(found, parts.select("part", "key", "pattern"), "part", "inner", hot, [F.col("line")])
    more = F.regexp_count("line", F.lit(r"\p{L}+")) > F.regexp_count("key", F.lit(r"\p{L}+"))  # a value besides the marks
    siblings = both.where(((F.col("template") == "") | more) & F.expr("line rlike pattern")).groupBy("key").agg(F.min("s0").alias("s0"), F.max("s1").alias("s1"))
    seen = again.where("kind = 'seen'").select("key", "digest").distinct().join(lines.select("key"), "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n_texts"))
    return siblings, seen, again.where("kind = 'page'").select("doc_id", "key", "n")


def residue(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_pages: int = 3, page_share: float = 0.8, min_copies: int = 30) -> DataFrame:
    """(doc_id, kind): documents with unfilled slots (placeholder), or that are filler, error page or script notice.

    Slots are induced by aligning records of one template: lines are grouped by what remains of them once
    marks of a slot and variable words are blanked, and a second reading finds the lines of other records
    that hold the template's fixed parts with values in place of the marks. Where the position varies between
    different texts, other values or other marks, it is a slot, and a line that keeps a variable name, a
    blank or a default there is residue (a line that tells of marks only beside real values). A mark that
    all texts with that line share is shown, not left. For a line that no other text has nothing can be
    aligned: there a mark that nothing else is written like, or whose name is made of several words, counts
    unless the line tells of marks.

    A page is residue if all it says apart from title and furniture is labelled as filler, an error or a
    notice, or is learnt to be: a line that no label fits is learnt if it recurs in pages of which at least
    half is labelled, in at least min_pages different texts and a share of page_share of all texts that hold
    it, long ones too. Whatever else it says, a page is residue if it leads with a labelled message, or a
    title with an HTTP status, and its whole template (variable words blanked) recurs in min_pages different
    texts or, copied word for word, in min_copies documents. Text in code marks and code blocks is shown on
    purpose; a sentence that reports an error has more to say than the error.

    Templates held by a large share of all lines are pre-aggregated, and joined back with salts.
    Defined results: null, empty and blank texts are no residue; repeated rows come out once an id, and
    copies of a text are one text; rows without id are left out; empty tables give no row; other columns are
    not read.
    """
    read = docs.select(F.col(doc_id).cast("bigint"), text)
    found = materialize(read.mapInArrow(_scan, _DDL), "residue")
    slot = found.where("kind = 'slot'")
    segment = found.where("kind = 'segment'")
    parts = segment.groupBy("key").agg(F.count_distinct("digest").alias("n_pages"), F.max("filler").alias("of"))
    candidates = materialize(parts.where(F.col("n_pages") >= min_pages), "candidates")
    siblings, seen, pages = read_again(read, slot.select("key").distinct(), candidates.select("key"))

    templates = slot.groupBy("key").agg(F.count(F.lit(1)).alias("n_rows"), F.min("digest").alias("t0"), F.max("digest").alias("t1"), F.min("filler").alias("f0"), F.max("filler").alias("f1"))
    alone = F.col("t0") == F.col("t1")
    facts = templates.select("key", alone.alias("alone"), (~alone & (F.col("f0") != F.col("f1"))).alias("marks_vary")).join(siblings, "key", "left")
    marked = salted_join(slot.select("doc_id", "key", "filler", "known", (F.col("n") > 0).alias("tells"), "digest"), facts, "key", "left", hot_keys(templates, "key", "n_rows"), [F.col("doc_id")])
    filled = F.coalesce((F.col("s0") != F.col("digest")) | (F.col("s1") != F.col("digest")), F.lit(False))
    compound = F.col("filler").rlike(r"[A-Za-z][_-][A-Za-z]") & F.col("filler").rlike(r"[{}<>$%\[]")
    left = marked.where(filled | (~F.col("tells") & (F.col("marks_vary") | (F.col("alone") & (F.col("known") | compound)))))

    learned = candidates.join(seen, "key").where(F.col("n_pages") >= F.col("n_texts") * page_share).select("key", "of")
    sizes = pages.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    learnt = (
        salted_join(pages, learned, "key", "inner", hot_keys(sizes, "key"), [F.col("doc_id")])
        .groupBy("doc_id", "n")
        .agg(F.count_distinct("key").alias("n_learned"), F.max("of").alias("kind"))
        .where("n_learned = n")
    )

    whole = found.where("kind = 'page'")
    repeated = whole.groupBy("key", "filler").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("digest").alias("n_texts"), F.count_distinct("doc_id").alias("n_docs"))
    hot = hot_keys(repeated.groupBy("key").agg(F.sum("n").alias("n")), "key")
    repeated = repeated.where((F.col("n_texts") >= min_pages) | (F.col("n_docs") >= min_copies)).select("key", F.col("filler").alias("of"))
    whole = salted_join(whole.select("doc_id", "key", "filler"), repeated, "key", "inner", hot, [F.col("doc_id")]).where("filler = of")
    return (
        found.where("kind in ('filler', 'notice', 'error')").select("doc_id", "kind")
        .unionByName(left.select("doc_id", F.lit("placeholder").alias("kind")))
        .unionByName(learnt.select("doc_id", "kind"))
        .unionByName(whole.select("doc_id", F.when(F.col("of").rlike("^[0-9]"), "error").otherwise(F.col("of")).alias("kind")))
        .groupBy("doc_id")
        .agg(F.min("kind").alias("kind"))
    )


def without_residue(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are not residue, with all their columns; rows without id stay."""
    bad = residue(docs, doc_id, text).select(F.col("doc_id").alias("_residue_id"))
    return docs.join(bad, F.col(doc_id) == F.col("_residue_id"), "left_anti")
