"""Rules that label trusted residue: placeholders outside code, and texts that are wholly filler, an error or a script notice.

A text is brought to plain words (no code, no markup, one case, single blanks). It is wholly residue if it has a sign of
residue and next to nothing else: all its words belong to the small vocabulary in which sites talk about themselves. A
post that talks about an error or quotes it has words of its own subject, speaks of itself (I, my, why) or asks.
"""

from __future__ import annotations

import re
import unicodedata
from http import HTTPStatus

import regex

_LINE_ENDS = regex.compile(r"\r\n?|[\x0b\x0c\x1c-\x1e\x85  ]")
_MARKS = regex.compile(r"[\p{Cf}\p{Cc}--[\n\t]]", flags=regex.V1)
_ASCII_MARKS = re.compile(r"[\x00-\x08\x0b-\x1f\x7f]")
_CODE = regex.compile(r"(?:```|~~~).*?(?:```|~~~|\Z)|(`+)(?!`)(?:(?!\n\s*\n).)+?(?<!`)\1(?!`)", regex.S)
_TAG = regex.compile(r"</?[a-z!][^<>]*>", regex.I)

_NAME = r"[A-Za-z_][\w.\- ]*+"
# The forms of a placeholder that a template engine or an author should have filled.
PLACEHOLDERS = [
    rf"\{{\{{\s*{_NAME}\s*(?:\|[^{{}}\n]*)?\}}\}}",
    r"\{%-?\s*(?:block|if|for|include|set|extends|end\w+)\b[^%\n]*%\}",
    r"<%[=\-]?\s*[\w.\[\]'\"() ]+?\s*-?%>",
    r"[$#]\{[A-Za-z_][\w.]*\}",
    r"(?<![\w$#{\"'])\{[A-Za-z_][\w.]*\}(?![\w}])",
    r"\[\[\s*[A-Za-z_][\w.]*\s*\]\]",
    r"<<\s*[A-Za-z_][\w.]*\s*>>",
    r"%\([A-Za-z_][\w.]*\)[sdf]\b",
    r"(?<![\w%])%%?[A-Za-z_][\w.]*%%?(?![\w%])(?<=%)",
    r"@@\s*[A-Za-z_][\w.]*\s*@@",
    r"(?<!#)##[A-Za-z_][\w.]*##",
    r"(?<![\w$])\$[A-Za-z_][\w.]*\$(?![\w$])",
    r"__[A-Za-z_][\w.]*?__TODO__",
    r"[<\[]\s*INSERT\s+(?:(?![<\[]\s*INSERT\s)[^\]>\n])+[>\]]",
    r"\[\s*Your\s++(?:(?!\[\s*Your\s)[^\]\n])+?(?<!\s)\s++here\s*\]",
    r"\[[^\[\]\n]+?\s(?:einfügen|eintragen|einsetzen|insérer|insertar|inserir)\]",
    r"\[(?:insérer|insertar|inserir|inserisci)\s(?:(?!\[(?:insérer|insertar|inserir|inserisci)\s)[^\]\n])+\]",
]
_PLACEHOLDER = regex.compile("|".join(PLACEHOLDERS), regex.I)
# Quotation marks.
_OPENING, _CLOSING = tuple("\"'“‘„«‚‹「"), tuple("\"'”’“»‘›」")
#: Every placeholder has one of these signs.
_SIGN = re.compile(r"[{%<\[@#$]|__")

_REASON = "|".join(sorted((regex.escape(s.phrase.lower()) for s in HTTPStatus if s >= 400), key=len, reverse=True))
_LONG_REASON = "|".join(sorted((regex.escape(s.phrase.lower()) for s in HTTPStatus if s >= 400 and " " in s.phrase), key=len, reverse=True))
_SERVER = r"(?:nginx|apache(?:[ \-](?:tomcat|coyote))?|openresty|tengine|lighttpd|litespeed|caddy|microsoft-(?:iis|httpapi)|varnish|squid|envoy|jetty|gunicorn|werkzeug|cloudflare)"
_PLACE = r"(?:page|site|website|forum|thread|questions?|answers?|comments?|posts?|contents?|articles?|topic|documents?|files?|resource|url|link|address|server|app|application|service)"

# What a program prints, in one piece.
PRINTED = [
    r"\{ ?\"(?:status|error|errors|code|message|detail|statuscode|error_code)\" ?:[^{}]*(?:\{[^{}]*\}[^{}]*)*\}",
    r"traceback \(most recent call last\):(?: ?file \"[^\"]*\", line \d+(?:, in [\w<>]+)?)+ ?(?:[\w.]*(?:error|exception)\b: ?(?:'[^']*'|\"[^\"]*\"|\S+)?)?",
    r"(?:php )?(?:warning|notice|fatal error|parse error|deprecated): [^.!]*? in /\S+ on line \d+",
    r"server error in '/[^']*' application",
    rf"(?:http(?:/\d(?:\.\d)?)?|http status|status|error|error code|code|fehler|erreur)?[ :#]*(?<![\w.])[(\[]?[45]\d\d[)\]]?(?![\w.]*\w)(?:[ :\-–(]+(?:{_REASON})\b)?\)?",
    rf"\b(?:{_LONG_REASON})\b",
    r"\b(?:nosuchkey|nosuchbucket|accessdenied|internalerror)\b",
]
# A note of an author that text is to follow, in one piece.
NOTES = [r"\[(?:todo|tbd|fixme)\b[^\]]*\]"]
# What stands around residue and does not tell it.
AROUND = [
    r"(?:home|start|questions|tags|users|about|help|log ?in|sign up)(?: ?\| ?(?:home|start|questions|tags|users|about|help|log ?in|sign up))+",
    r"^[\w .\-]{1,40} ={3,}|^[\w .\-]{1,40} ?[–|\-] ?(?:questions and answers|forum|community|help|support)\b",
    r"\b(?:request id|incident(?: id)?|ref|ray|ray id|reference|error code|error id|id)[ :#]*[0-9a-f]*\d[0-9a-f]*\b|content-length: \d+|[(\[][0-9a-f]+[)\]]|\b(?=[a-f]*\d)[0-9a-f]{8,}\b",
    rf"(?:{_SERVER}/\d[\w.\-]*(?: \([\w ./\-]+\))?(?: [a-z_\-]+/[\w.\-]+)*(?: server at \S+ port \d+)?|(?:faithfully yours, )?{_SERVER}[.]?)$",
    r"\b(?:back to (?:the )?(?:start|home|main|front) ?page|go back|reload(?: the page)?|please wait|loading)\b[.…]*",
    r"(?<=\s)(?:https?:/)?/\S+|\(?\bhost [\w.\-]+\)?|'[\w./]*'|\b(?:after|in) \d+ (?:ms|s|seconds|minutes)\b|\bor delete it\b",
]
# Signs of an error message of a site or server.
ERRORS = [
    rf"\b{_PLACE}\b.*\b(?:(?:was|is|are|were|could|can)(?: not|n't)(?: be)? (?:found|here|available|reachable|working|responding)|(?:does|do)(?: not|n't) exist|leads? nowhere|no longer (?:available|exists?|here)|(?:been|was|were) (?:removed|deleted|moved|closed|taken down))",
    rf"\b{_PLACE}\b.*\b(?:can(?:'t|not| not)|could(?:n't| not)) be (?:reached|found|displayed|shown|opened|loaded|built|rendered|processed|completed)",
    rf"\b{_PLACE} not found|\b{_PLACE}\b.*\b(?:unavailable|unreachable|offline|overloaded|is down|took too long)",
    r"\b(?:is|are) out of reach\b|\bdown for \w+|\b(?:under|scheduled) maintenance\b",
    r"\baccess\b.*\bdenied|\b(?:lack|do not have|don't have|no) (?:the )?permissions?\b|\bnot (?:authorized|allowed) to (?:view|see|access|open)",
    r"\b(?:session|page|link|token) (?:has |is )?(?:expired|timed out|ended)",
    r"\b(?:request|connection|account|address|ip)\b.*\b(?:blocked|refused|rejected|denied|forbidden|reset)\b|\b(?:will )?be (?:right )?back (?:soon|shortly|later)\b",
    r"\bsomething went wrong|\b(?:an|internal|unexpected|fatal|unknown) error\b|\btechnical (?:difficulties|problems?)",
    r"\b(?:unable|not able|failed) to (?:connect|complete|process|handle|load|open|reach|render|display|establish)",
    r"\b(?:could(?:n't| not)|can(?:'t|not)) (?:connect|load|open|process|reach|complete|handle|establish|display)",
    r"\b(?:timed out|no (?:answer|response) in time)\b|\b(?:invalid|no) response from\b",
    r"\btoo many requests\b|\bslow down\b|\brate limit\b",
    r"\b(?:render|rendering|request|connection|loading) failed\b|\berror (?:establishing|loading|rendering)\b",
    r"\b(?:try|come) (?:again |back )+(?:later|soon|in a few)|\btry later\b",
    r"\b(?:operators?|administrators?|team|staff) (?:was|were|has been|have been) (?:told|notified|informed|alerted)",
    r"\b(?:seite|inhalt|server|dienst)\b.*\b(?:nicht (?:erreichbar|gefunden|verfügbar|mehr)|gibt es nicht|existiert nicht|konnte nicht)|\binterner serverfehler|\bzugriff verweigert|\bsitzung ist abgelaufen",
    r"\b(?:page|contenu|serveur|service)\b.*\b(?:introuvable|non trouvée|n'existe (?:pas|plus)|n'a pas pu|indisponible)|\berreur interne|\baccès (?:refusé|interdit)|\bsession a expiré",
    r"\bno se (?:encontró|pudo)\b.*\b(?:página|contenido|solicitud)|\b(?:página|servidor|contenido)\b.*\b(?:no (?:encontrad[ao]|existe|pudo|está disponible))|\berror interno|\bacceso denegado|\bsesión ha (?:caducado|expirado)",
    r"\b(?:página|servidor|conteúdo)\b.*\bnão (?:foi )?(?:encontrad[ao]|existe|pôde|conseguiu|está disponível)|\berro interno|\bacesso negado|\bsessão expirou",
    r"\bpagina\b.*\b(?:non (?:trovata|esiste)|niet gevonden)|\bservizio non disponibile|\baccesso negato|\btoegang geweigerd",
    r"(?:ページ|サーバー|アクセス|セッション).*(?:見つかりません|エラー|拒否されました|切れました|利用できません)",
]
_SCRIPT = r"(?:java ?script|(?:client-side )?scripts?\b|\bjs\b|scripting\b)"
_ON = r"(?:enabl|allow|activat|unblock|permit)\w*|(?:turn|switch)\w* (?:\w+ )?on|on"
_OFF = r"disabled|blocked|blocks|off|deactivated|not (?:enabled|available|supported|running|allowed)|could(?:n't| not) be started|(?:does(?:n't| not)|don't) support"
# Signs of a notice that scripts or a browser check are needed.
NOTICES = [
    rf"{_SCRIPT}.*\b(?:{_ON}|{_OFF}|required|needed)\b|\b(?:{_ON}|{_OFF}|require[sd]?|needs?)\b.*{_SCRIPT}",
    rf"\b(?:without|loaded (?:by|with)|by means of) {_SCRIPT}",
    r"\b(?:checking|verifying|we check|we verify)\b.*\b(?:browser|connection|human|robot)\b|\b(?:verify|confirm|prove|check)\b.*\b(?:you are (?:a )?human|(?:not|n't) a (?:ro)?bot)",
    r"\bbrowser is (?:too old|out of date|outdated|not supported)|\b(?:enable|allow) cookies\b",
    r"javascript.*\b(?:aktivier|ein(?:schalt|geschalt)|erlaub|nötig|benötig|erforderlich|deaktiviert|activ|autoris|nécessaire|désactivé|habilit|permit|ativ|lig(?:ar|ue)\b|attiv|abilit|inschakel|schakel|włącz|включ|necesari|necessári)",
    r"\b(?:aktivier|erlaub|benötig|braucht|activ|autoris|nécessit|exige|habilit|permit|ativ|lig(?:ar|ue)\b|attiv|abilit|inschakel|schakel|włącz|включ|necesit|requiere|precis)\w*.*(?:javascript|\bscripts\b)",
    r"javascript ?を(?:有効|オン)",
]
_COPY = r"(?:text|content|copy|post|page|article|answer|question|description|paragraph|heading|title|body)s?"
# Signs of filler where content should be.
FILLER = [
    rf"\b(?:sample|dummy|filler|placeholder|mock|example) {_COPY}\b|\bplaceholder\b",
    rf"\b{_COPY}\b.*\b(?:to (?:follow|be (?:supplied|added|replaced|written|provided))|(?:goes|comes|will go) here|coming soon|will follow|follows|not yet (?:written|available)|pending)\b",
    rf"\b(?:enter|insert|add|type|write|put)\b.*\b(?:here|in (?:this|the) (?:box|field|area))\b|^\W*(?:enter|insert|add|type|write|put) (?:your |the |a |some )?(?:{_COPY} )?{_COPY}\W*$",
    r"\bto be (?:replaced|announced|defined|written)\b|\breplace before publishing\b|\b(?:tbd|tba|tbc|todo|fixme)\b|^\[[\w ]*\]$",
    r"\b(?:text|inhalt) folgt\b|\bhier (?:steht|kommt)\b.*\btext\b|\bplatzhalter\b|\btexte à venir|\b(?:texte|contenu) (?:à venir|suivra)|\b(?:contenido|texto) (?:pendiente|por venir)|\b(?:conteúdo|texto) (?:em breve|a seguir|pendente)|\bpróximamente",
    r"(?:準備中|工事中)|ここに.*が入ります",
]
# The words in which sites talk about themselves, and the small words between them.
VOCABULARY = set(
    """a an the this that these those it its it's you you're your yours our we're of in on at for by with without from to and or but not no nor is are
was were be been being has have had may might must need needs can can't cannot could couldn't will won't would do does did don't doesn't didn't please
kindly sorry oops well isn't aren't wasn't weren't hasn't haven't we'll we've i'm that's there's about below above long right if us which whose once we so then than too only first again later soon now here there out up down off over back few some something nothing anything
everything all any more longer yet still already before another other just one moment minute minutes second seconds hour hours ms time times as s
home start page pages site website web forum thread threads question questions answer answers comment comments post posts content contents text full
article articles topic board community app application document file resource url link address server host node cache database proxy gateway upstream
connection request requests requested response session cookie cookies browser domain setting settings script scripts scripting javascript java js client
side client-side permission permissions access account service system network error errors code status message id ref reference ray incident operator
operators administrator administrators admin owner team staff support end tags users about help login log logged sign search line
found exist exists removed deleted moved renamed changed name unavailable available denied forbidden unauthorized expired timed timeout failed fail fails
went wrong reached reach reachable unreachable displayed display shown show loaded loading load built rendered render rendering open opened view viewing
see read reading use connect connected connecting establish establishing handle handled process processed complete completed unable able encountered
occurred received invalid internal unexpected temporarily temporary scheduled maintenance upkeep offline busy overloaded lost closed locked blocked
blocks block limit exceeded many slow wait try retry refresh reload return took come go continue told notified informed alerted looking asked followed leads
nowhere lack lacks technical difficulties problem problems awkward template raised got given misconfiguration condition unknown rate while trying
directory apologize inconvenience report reported respond responding responded contact information details logs mistyped typed incorrect bad gateway mistake existing issue issues
traffic heavy currently undergoing performing improve improving fix fixing working on it's refused rejected too large small ip security policy reason
enable enabled enables disable disabled allow allowed allows activate activated turn turned turns switch switched permit unblock required requires require
supported work works working properly run runs running started check checks checking verify verifying confirm human robot bot secure security automatic
automatically takes take hold ensure make sure completing complete action continue proceed enter order blocker old older modern seems
sample dummy filler placeholder mock example copy heading item paragraph section title body description replaced replace supplied added follow follows
coming comes goes written write writing type insert add put useful box min max characters layout edit delete publishing tbd tba tbc todo fixme pending
und oder die der das den dem ein eine einen ist sind nicht mehr es gibt diese dieser seite seiten server fehler konnte wurde vorübergehend erreichbar
gefunden verfügbar wartungsarbeiten wartung bitte aktivieren sie javascript um zu sehen antworten für muss eingeschaltet aktiviert sein deaktiviert nutzen verwenden angeforderte gewünschte leider später erneut versuchen wird gewartet
ausgeschaltet benötigt braucht hier steht bald ihr dein text texte folgt kürze inhalt platzhalter interner serverfehler zugriff verweigert ihre sitzung
abgelaufen angezeigt werden
le la les demandée recherchée l'exécution de des du d'un une un cette ce page pages serveur n'a pas pu traiter demande introuvable trouvée non n'existe plus veuillez activer
pour afficher exige nécessite est désactivé votre navigateur session expiré erreur interne accès refusé interdit à venir contenu suivra service
indisponible réponses lire
el los las que busca buscada no se encontró encontrada encontrado página solicitada solicitado existe activa active javascript para ver esta este necesita requiere por
favor su sesión ha caducado error interno del acceso denegado servidor pudo procesar solicitud contenido pendiente texto próximamente está disponible
a o os as é não foi pôde conseguiu preciso ligar ler respostas habilite habilita ative sua sessão expirou erro acesso negado conteúdo em breve seguir
pendente
pagina non trovata esiste niet gevonden servizio attivare attiva abilitare il inschakelen schakel""".split()
)
# Words of someone who tells or asks.
TELLING_PERSON = set("i i'm i've me my mine us why how when whenever since because although who ich mein mir je mon nous yo mi eu meu noi".split())


def _any(patterns: list[str]) -> regex.Pattern:
    return regex.compile("|".join(f"(?:{p})" for p in patterns), regex.V1)


_SIGNS = [(kind, _any(p)) for kind, p in (("notice", NOTICES), ("filler", FILLER), ("error", ERRORS))]
VOCABULARY.update(w for s in HTTPStatus if s >= 400 for w in s.phrase.lower().replace("'", " ").split())
_NOTES, _PRINTED, _FURNITURE = _any(NOTES), _any(PRINTED), _any(AROUND)
_ONE_WORD_REASON = regex.compile(rf"[\W]*(?:error\W+)?(?:{_REASON})\W*", regex.V1)
_TOKEN = regex.compile(r"[\p{L}\p{M}]+(?:['\-][\p{L}\p{M}]+)*|\d+")
_FOREIGN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_SENTENCE, _SPEECH, _PROGRAM = re.compile(r"[。！!.]"), re.compile(r"[?？\"«„“「]"), re.compile(r"\{|traceback| on line ")
#: One word in so many may be no word of the vocabulary.
UNKNOWN_ONE_IN = 14
#: So many words beyond the vocabulary at most are in what stands around residue (titles, paths, ids).
TAKEN_OFF = 8

# The standard passage, further words of mock Latin and of its generators, and frequent words that tell it from real languages.
PASSAGE = """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim
ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat duis aute irure dolor in reprehenderit
in voluptate velit esse cillum dolore eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt in culpa qui officia
deserunt mollit anim id est laborum"""
GENERATED = """ac accumsan aenean aliquam aliquet ante arcu at auctor augue bibendum blandit condimentum congue consectetuer convallis cras curabitur
cursus dapibus diam dictum dictumst dignissim donec egestas eget eleifend elementum erat eros etiam euismod facilisi facilisis fames faucibus
felis fermentum feugiat finibus fringilla fusce gravida habitant habitasse hac hendrerit iaculis imperdiet integer interdum justo lacinia
lacus laoreet lectus leo libero ligula lobortis luctus maecenas malesuada massa mattis mauris maximus metus mi molestie mollis morbi nam nec
neque netus nibh nisl nulla nullam nunc odio orci ornare pellentesque pharetra phasellus placerat platea porta porttitor posuere potenti
praesent pretium primis proin pulvinar purus quam quisque rhoncus risus rutrum sagittis sapien scelerisque sem semper senectus sodales
sollicitudin suscipit suspendisse tellus tempus tincidunt tortor tristique turpis ultrices ultricies urna ut varius vehicula vel venenatis
vestibulum vitae vivamus viverra volutpat vulputate"""
MOCK = set(f"{PASSAGE} {GENERATED}".split())
#: Words of the passage that no living language has.
CLASSIC = {w for w in PASSAGE.split() if len(w) > 3} - set("anim enim esse irure nisi nulla quis sint sunt minim magna velit elit labore tempor culpa fugiat officia".split())
# Frequent words of real posts that mock Latin lacks, and endings of Latin.
FREQUENT = set(
    """the and is are was were be been to of for with that this these those it its on as by from or not but have has had you your we our they he she
i my what when where which who why how can could should would will if so there here then than more some any all no yes an after before between
into about only does did just also please thanks der die das und ist sind nicht ein eine einen mit von zu den dem auf für wie wenn ich wir sie es
auch nur aber oder bei nach aus im am le la les un une des du de que qui est pas pour dans sur avec mais ou où je nous vous il elle ce cette
el los las una y por para con del al se lo como pero más cuando este esta o os um uma da dos das não por mais como mas ao na no il di che per gli
della sono""".split()
) - MOCK
_WORD = re.compile(r"\w+")
# Endings of Latin words, and small words of Latin.
_LATIN_END = re.compile(r"[a-z]*(?:[aeio]|us|um|is|as|es|os|in|am|em|at|et|it|ut|nt|ur|non|or|ad)")
PARTICLES = {"et", "in", "non", "sit", "ut", "ad", "ac", "nec", "ex"}
#: Mock text of these words and more may hold any words beside those of the passage, of which one in so many must be; and how many words must end like Latin.
MOCK_WORDS, CLASSIC_ONE_IN, LATIN_WORDS = 12, 20, 8


def visible(text: str) -> str:
    """The text with one kind of line end and without control and format characters."""
    if text.isascii() and not _ASCII_MARKS.search(text):
        return text
    return _MARKS.sub("", _LINE_ENDS.sub("\n", text))


def without_code(text: str) -> str:
    return _CODE.sub(" ", text) if "`" in text or "~~~" in text else text


def has_placeholder(prose: str) -> bool:
    """Whether a text without code holds a placeholder that was never filled; one directly between quotation marks is quoted."""
    if not _SIGN.search(prose):
        return False
    return any(prose[m.start() - 1 : m.start()] not in _OPENING or prose[m.end() : m.end() + 1] not in _CLOSING for m in _PLACEHOLDER.finditer(prose))


def plain(prose: str) -> str:
    """A text without code as plain words: no tags, compatibility forms replaced, lower case, single blanks."""
    text = prose if prose.isascii() else unicodedata.normalize("NFKC", prose).replace("’", "'")
    return " ".join((_TAG.sub(" ", text) if "<" in text else text).lower().split()).strip(" *")


def _over_and_over(words: str) -> bool:
    """The same sign, or the same one or two words, over and over."""
    if words.count(words[0]) + words.count(" ") == len(words) and len(words) - words.count(" ") >= 6:
        return True
    for n in (1, 2):
        unit = words.split(" ", n)[:n]
        if len(unit) == n and all(t.isalnum() for t in unit) and len(set(unit)) == n:
            tokens = words.split(" ") if f"{words} ".startswith(f"{' '.join(unit)} " * 3) else []
            if tokens and all(t == unit[i % n] for i, t in enumerate(tokens)):
                return True
    return False


def _mock_latin(words: str) -> bool:
    """Mock Latin, of known or invented words, without the frequent words of real languages.

    A short text holds hardly any words but known ones. A longer one holds enough words of the passage, or small words of
    Latin and hardly any that don't end like Latin.
    """
    # A text has at most one word for two characters, so enough frequent words tell without looking closer.
    if sum(map(FREQUENT.__contains__, words.split(" "))) > 0.01 * (len(words) / 2 + 1):
        return False
    tokens = [t for t in _WORD.findall(words) if not t.isdigit()]
    n = len(tokens)
    if n < 3 or sum(t in FREQUENT or not t.isascii() for t in tokens) > 0.01 * n:
        return False
    classic, known = sum(t in CLASSIC for t in tokens), sum(t in MOCK for t in tokens)
    if len(CLASSIC.intersection(tokens)) >= 2 and (known >= 0.85 * n or n >= MOCK_WORDS and classic * CLASSIC_ONE_IN >= n):
        return True
    return n >= LATIN_WORDS and not PARTICLES.isdisjoint(tokens) and sum(_LATIN_END.fullmatch(t) is not None for t in tokens) >= 0.85 * n


def _strange(words: str) -> bool:
    """Whether a text has too many words beyond the vocabulary, or someone tells or asks in it."""
    unknown = n = 0
    for m in _TOKEN.finditer(words):
        token = m.group()
        n += 1
        if token not in VOCABULARY and not token.isdigit():
            if token in TELLING_PERSON:
                return True
            unknown += 1
    return unknown > n // UNKNOWN_ONE_IN


def once(words: str) -> str:
    """A text that is the same text over and over, once."""
    unit = f"{words} "
    return unit[: (unit + unit).find(unit, 1) - 1]


def _of_its_own(words: str) -> bool:
    """Whether someone tells or asks, or more words are of a subject of its own than can be taken off; a program's output is told by its signs."""
    tokens = [t for t in words.split(" ") if t[0].isalpha()]
    if not TELLING_PERSON.isdisjoint(tokens):
        return True
    unknown = sum(t not in VOCABULARY and t.rstrip(".,:;!…)") not in VOCABULARY for t in tokens)
    return unknown > len(tokens) // UNKNOWN_ONE_IN + TAKEN_OFF and not _PROGRAM.search(words)


def _sign(words: str) -> str | None:
    return next((kind for kind, signs in _SIGNS if signs.search(words)), None)


def whole_residue(words: str) -> str | None:
    """``error``, ``notice`` or ``filler`` if the plain words are wholly residue, else None."""
    if not words:
        return None
    if _over_and_over(words) or _mock_latin(words):
        return "filler"
    words = once(words)
    if _of_its_own(words):
        return None
    rest, notes = _NOTES.subn(" ", words)
    rest, printed = _PRINTED.subn(" ", rest)
    rest, around = _FURNITURE.subn(" ", rest)
    if _SPEECH.search(rest):
        return None
    if _FOREIGN.search(rest):
        kinds = [_sign(part) for part in _SENTENCE.split(rest) if _TOKEN.search(part)]
        return kinds[0] if all(kinds) else None
    # A single word such as "gone" tells an error only beside other pieces.
    if around and _ONE_WORD_REASON.fullmatch(rest):
        return "error"
    return None if _strange(rest) else _sign(rest) or ("filler" if notes else "error" if printed else None)
