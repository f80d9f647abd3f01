"""Template residue and error-page text.

Three steps. (1) Each text is cut into statements outside code, quotes and code spans. Numbers, addresses, ids and dates are masked in a
statement, and the exact hash of what remains groups equal *messages* over all documents and sources: a message has the number of
documents and of sources in which it occurs. (2) Each message is judged once, whatever the number of its copies. Phrase rules name
messages of error pages, notices, fillers and empty forms. A message that a phrase covers from end to end is residue; one that only
begins with a phrase, or only has the cues of a notice or an error, is residue if it recurs widely: in several documents of
several sources. (3) The verdicts go back to the documents, which are residue where such messages outweigh the rest;
placeholder rules find slots left open in prose.

Everything is built from JVM expressions. Statements leave their rows once per task and message.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.lineage import cut, scratch_path

# Phrases of notices, error pages, fillers and empty forms (English, German, Spanish).
NOTICE = [
    r"(please |bitte |por favor,? )?(enable|turn on|switch on|activate|allow|aktivieren sie|active|habilite) (the )?(java ?script|scripts?|scripting|cookies)\b.*",
    r"(java ?script|scripting|scripts?|cookies) (is|are|ist|sind|está|están) (off|disabled|required|blocked|switched off|turned off|not enabled|deaktiviert|ausgeschaltet|erforderlich|desactivad[oa]s?)\b.*",
    r"(java ?script|scripts?|cookies)( and (cookies|scripts))? required",
    r"(this|the|our) (site|page|app|viewer|application|website)\b.{0,60}\b(needs|requires|need|require|works only with|does not work without) (cookies|scripts?|java ?script)\b.*",
    r"(the )?app shell could not start\b.*",
    r"you (need|have) to (allow|enable|accept) (cookies|scripts|java ?script)\b.*",
    r"we use cookies\b.*",
    r"accept (them|cookies|all cookies)\b.*",
    r"turn (them|it) on in your browser.*",
    r"your browser (is|does) not (supported|support)\b.*|your browser is (too old|out of date|outdated)\b.*",
    r"update it or switch to another one\b.*",
    r"(please )?(confirm|prove|verify|show) that you are (a )?(human|not a (ro)?bot)\b.*",
    r"(we are )?checking (that you are|your browser|if you are|whether you are)\b.*",
    r"if nothing happens, check\b.*",
    r"noscript:?",
    r"diese (seite|webseite|anwendung) (benötigt|braucht|erfordert)\b.*",
    r"(ihr|dein) browser wird nicht unterstützt\b.*",
    r"wir prüfen, ob sie\b.*|comprobando que (no )?es\b.*|überprüfung, ob sie\b.*",
    r"(bitte )?bestätigen sie, dass sie (ein mensch|kein (ro)?bot)\b.*",
    r"(este|esta) (sitio|página|aplicación) (necesita|requiere)\b.*",
    r"para ver esta página es necesario\b.*",
    r"(su|tu) navegador no (es compatible|está)\b.*",
    r"confirme que (es|no es)\b.*",
    r"(nosotros )?(usamos|utilizamos) cookies\b.*|wir verwenden cookies\b.*",
]
ERROR = [
    r"(http |server |application |status |http status )?(error|fehler|code|status)\W{0,3}#?[1-5]\d\d\b.{0,80}",
    r"(error |fehler )?[45]\d\d\W{0,3}(not found|forbidden|bad gateway|internal server error|service unavailable|gateway timeout|unauthorized|too many requests|nicht gefunden|no encontrad[oa])\b.{0,40}",
    r"(the |this )?page( that)?( you (asked|are looking|looked) for)? (could not be|was not|cannot be|not) found\b.{0,20}",
    r"(the |this )?(page|document|file|resource)( you (asked|requested|are looking) ?(for)?)? (could not be found|is not available|does not exist|is no longer available|has been (re)?moved)\b.{0,40}",
    r"(this|the) (document|page) is not available\b.*",
    r"it may have been (removed|moved|deleted)\b.*",
    r"you do not have permission to\b.*|access (to \S+ )?(is )?(denied|forbidden)\b.{0,40}",
    r"sign in with another account\b.*",
    r"your session has (expired|ended)\b.*|please log in again\b.*",
    r"something (broke|went wrong)\b.*",
    r"(we are|the site is|the \w+ pages (are|will be)) (down for|back|under) ?(scheduled|planned|shortly)?\b.*",
    r"the .{1,40} pages will be back\b.*",
    r"(please )?(try|come back) again (in|later)\b.*",
    r"the server (returned|sent|closed|could not)\b.*",
    r"the .{1,50} service did not (answer|respond)\b.*",
    r"too many requests\b.*|slow down and retry\b.*",
    r"render of /\S+ failed\b.*",
    r"application error\b.*",
    r"at \S+ \(\S+:\d+:\d+\).*",
    r"rawerrorpage\b.{0,80}",
    r"(der|die|das) angeforderte\b.*|kein zugriff auf\b.*|der dienst .{1,40} ist (zurzeit|derzeit|momentan)? ?nicht\b.*|sin acceso a\b.*|el contenido solicitado\b.*",
    r"the link you followed\b.*",
    r"go back to the start page\b.*|use the search box\b.*",
    r"bad gateway|service unavailable|gateway timeout|internal server error|access denied|forbidden|not found",
    r"(bad gateway|service unavailable|gateway timeout|internal server error) (go back|sign in|try again|please log in|slow down|then press)\b.*",
    r"(die )?seite (wurde )?nicht gefunden\b.*|die (angeforderte|gesuchte) seite\b.*",
    r"(ihre|deine) sitzung ist abgelaufen\b.*|bitte melden sie sich (erneut|wieder) an\b.*",
    r"zurück zur startseite\b.*|(bitte )?versuchen sie es (später|in)\b.*",
    r"(la )?página (solicitada )?no (existe|se encontró|encontrada|está disponible)\b.*|la página solicitada\b.*",
    r"su sesión ha (caducado|expirado)\b.*|(vuelva a )?inici(e|ar) sesión\b.*",
    r"(inténtelo|inténtalo|intente|pruebe) (de nuevo|más tarde|otra vez)\b.*|volver al inicio\b.*|después vuelva a cargar\b.*",
    r"der server (hat|ist|antwortet)\b.*|el servidor (no|ha|está)\b.*",
    r"etwas ist schief\s?gelaufen\b.*|algo (ha salido|salió) mal\b.*",
    r"(sie haben|keine) (keine )?berechtigung\b.*|no tiene permiso\b.*|zugriff verweigert\b.*|acceso denegado\b.*",
    r"request \S+ failed with status \d+.*|el servicio .{1,40} no responde\b.*|der dienst .{1,40} antwortet nicht\b.*",
    r"(wegen|wir führen) wartung.*|.{0,40}wartungsarbeiten\b.*|.{0,30}\bmantenimiento programado\b.*",
    r"zu viele anfragen\b.*|demasiadas (solicitudes|peticiones)\b.*",
]
FILLER = [
    r"(text|content|copy|words?) goes here",
    r"sample text",
    r"(content|text|copy|more) coming soon",
    r"dummy (paragraph|text)",
    r"this paragraph stands in for\b.*",
    r"it has no meaning\b.*",
    r"placeholder for the\b.*",
    r"more words will follow\b.*",
    r"(hier (steht|kommt|folgt)|an dieser stelle (steht|folgt))\b.*(text|inhalt)\b.*",
    r"(platzhaltertext|blindtext|beispieltext|mustertext|texto de (ejemplo|relleno|muestra))\b.*",
    r"(dies|das) ist (ein )?(blindtext|platzhalter|beispieltext)\b.*|(este|esto) es (un )?texto de (relleno|ejemplo|muestra)\b.*",
    r"(inhalt|text) folgt( in kürze| bald)?",
    r"aquí irá\b.*|contenido (próximamente|en preparación)\b.*",
    r"(dieser absatz|este párrafo) (steht|dient|ocupa|sirve|es)\b.*",
]
FORM_STUB = [
    r"tbd|tba|todo|tbc|fixme|xxx",
    r"\.{2,}|…|-+|_+",
    r"- \[ \]( ?(\.{2,}|…))?",
    r"<!--.*-->",
    r"[_*(\[<]*(please )?(describe|fill|add|insert|write|enter|explain)\b.{0,40}[_*)\]>]*",
    r"\(?to be (filled in|written|done|decided|completed)\)?",
    r"write a few sentences here",
    r"delete this section\b.*",
    r"(n/a|none|-)( ?\| ?(n/a|none|-))*",
    r"[_*(]*(bitte )?(ausfüllen|beschreiben|hier beschreiben|hier ausfüllen|ergänzen|folgt)[_*)]*",
    r"[_*(]*(por completar|pendiente|por definir|describa .{0,30}|describe aquí.{0,30}|rellenar|completar)[_*)]*",
    r"(diesen abschnitt löschen|abschnitt löschen|elimine|borre|eliminar) .{0,60}",
    r"(hier )?ein paar sätze.{0,20}|escriba unas frases.{0,20}|escribe unas frases.{0,20}",
]
# Page furniture: says nothing alone, but goes with an error page or a notice.
FURNITURE = [
    r"path: \S+|hoppla|oops|sorry|hold on|one moment|loading|not available|nothing here|please wait|uh oh|hm+|whoops|notice|un momento|aviso|hinweis|¡?vaya|einen moment|moment|lo sentimos|entschuldigung|cargando|laden|wird geladen",
    r"(this|das|esto) (takes|dauert|tarda|tardará) (a few|einige|unos|ein paar) (seconds|sekunden|segundos|moments|augenblicke)",
    r"(danach|anschließend) bitte .{0,20}laden|[45]\d\d",
    r"(then|dann|luego) (press|click|hit)? ?reload.*|.{0,20}(neu laden|recargar).{0,20}",
    r"(home|start|inicio|startseite) ?[>/|].*",
    r".{1,30}\| ?(menu|menü|menú|search|suche|buscar).*|.{1,20} docs ?\|.*",
    r"(terms|privacy|status|impressum|datenschutz|about|contact)( {1,3}[|·-]? {0,3}(terms|privacy|status|impressum|datenschutz|about|contact))*",
    r"(\[[a-z ]{1,20}\] ?){2,}",
    r"\(c\) .{0,40}|© .{0,40}",
    r"(request|ref|trace|ray|reference|anfrage|incident)( id)?:? ?[0-9a-f-]{6,}",
    r"(error|fehler)",
]
# What page furniture may run straight into a message when line breaks are lost.
LEAD = r"(?iu)^(?:(?:oops|hoppla|sorry|hold on|one moment|please wait|loading|not available|something broke|scripts required|uh oh|whoops|un momento|aviso|hinweis|¡?vaya|einen moment|path: \S+|(?:home|start|inicio|startseite) > \w+(?: > \w+)*|\w+ docs \| \w+ \| \w+|(?:error|fehler) ?[45]\d\d|[45]\d\d|(?:\[\w+\] ?){2,}|noscript:)[.!…:]*\s+)+(?=\S)"
TRAIL = r"(?iu)(?:\s+(?:(?:request id|ref|trace) [0-9a-f]{6,}|\(c\) \w+ docs|terms\s+privacy\s+status))+\s*$"
LOREM = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud nunc nulla felis porta vitae massa urna arcu quam velit erat libero".split()
MASH = "asdf asdfgh qwer qwerty jkl foo bar baz blah test xxx 1234 abc zxcv hjkl".split()
SLOTS = [
    r"\{\{[-#/^>&~]?\s*[A-Za-z_][\w .|-]{0,40}\}\}",
    r"\[\[\s*[A-Za-z_][\w -]{0,40}\s*\]\]",
    r"<%[=-]?\s*[\w.]{1,40}\s*-?%>",
    r"\{%-?\s*[A-Za-z_][\w ]{0,40}\s*-?%\}",
    r"#\{\s*[A-Za-z_][\w.]{0,40}\s*\}",
    r"\$\{\s*[A-Za-z_][\w.]{0,40}\s*\}",
    r"@@[A-Za-z_]\w{1,40}@@",
    r"(?<![\w%])%[A-Za-z_]{3,40}%(?![\w%])",
    r"\{\d+:[A-Za-z_]\w{0,40}\}",
    r"<(?:your|insert|enter|add)[- _][\w -]{1,40}>",
    r"<[\w -]{1,40} (?:goes )?here>",
    r"\[(?:INSERT|insert|Insert|YOUR|your|Your|TODO:?|ENTER|enter|ADD|EINFÜGEN|INSERTAR)[ :_-][^\]\n]{1,40}\]",
    r"\[[A-Z][\w ]{1,30} (?:EINFÜGEN|HERE|here|einfügen|AQUÍ|aquí)\]",
    r"«\s*[A-Za-z_][\w ]{0,40}»",
    r"__[A-Z][A-Z_]{2,40}__",
    r"\b[A-Z][A-Z_]*_(?:PLACEHOLDER|HERE|GOES_HERE)\b",
    r"\$\([A-Z_]{3,40}\)",
]
# A page or an error object as the server sends it.
PAGE = r"(?is)(?:<!doctype[^>]*>\s*)?<html\b.*?</html>|\{\s*\"(?:status|error|code)\"\s*:[^{}]*\}"
CODE_LINE = r"(?m)^\s*(?:(?:import|export|const|let|var|function|class|interface|return|async|await|if|for|while|switch|case|default:|throw|try|catch|else|enum|type [A-Z]|@\w+\(|describe\(|it\()\b?.*[;{(,}=>\]:]\s*|[\w.$'\"\[\]]+(?:\(.*\)|\s*[=:+-]=?\s*[^.]*)[;,{(]\s*|.*(?:=>|\{|\};?|\);|\},|/>|</\w+>\)?[;,]?)\s*|\.\w+\(.*|[)\]};,]+|//.*|/?\*.*|<[A-Za-z]\w*(?:\s[^>]*)?>?\s*|\s+\w+=\{.*|\{[\w.]+\})$"
# Cues of a page's message that no phrase names, by what they are about (English, German, French, Spanish).
CUE_THING = r"java ?script|scripts?\b|cookies?\b|browser|navigateur|navegador|captcha|robot|\bbot\b|ad ?block|session|sitzung|sesión|page|seite|página|site\b|website|sitio|server|serveur|servidor|service|dienst|servicio|request|requête|anfrage|solicitud|petición|connection|connexion|verbindung|conexión|network|netzwerk|réseau|account|konto|compte|cuenta|\blink\b|lien|enlace|\b(?:an error|ein fehler|une erreur|un error)"
CUE_TROUBLE = r"\berror|erreur|fehler|unavailable|indisponible|nicht verfügbar|no disponible|not (?:be )?(?:found|available|supported|loaded|displayed|reach)|introuvable|nicht gefunden|no encontrad|denied|refusé|verweigert|denegad|expired|expiré|abgelaufen|caducad|expirad|fail|échou|fehlgeschlagen|falló|fallid|time[d ]? ?out|maintenance|wartung|mantenimiento|offline|hors ligne|went wrong|wrong|could not|cannot|konnte nicht|kann nicht|no se pudo|survenue|trouble|problem|problème|blocked|bloqué|blockiert|bloquead|disabled|désactivé|deaktiviert|desactivad|required|requis|erforderlich|necesari|unusual|unexpected|inattendu|overloaded|forbidden|no longer|n'existe|suspended|human|humain|mensch|humano|unable|impossible|enable|activ(?:er|ez|ate|ar)\b|aktivieren|habilit|accept(?:er|ez)?\b|akzeptieren|acept(?:ar|e)"
CUE_READER = r"\b(?:please|you|your|try again|retry|refresh|reload|return to|go back|sign in|log ?in|contact|click|on our (?:side|end)|bitte|sie|ihre?n?|erneut|zurück|veuillez|vous|votre|réessayez|rechargez|por favor|usted|inténtelo|intente|vuelva|recargue|actualice)\b"
#: What people say about such things, not the things themselves.
NARRATIVE = r"\b(?:we (?!use cookies|could not|cannot|can't|are sorry|(?:have )?detected|(?:have )?noticed)|i\b|was due|were|fix(?:ed|es)?|because|tests?|tested|bug|instead|added|removed|changed|merged?|weil|wurde[n]?|wir (?!verwenden|prüfen|führen)|porque|fue|añad\w+|nous (?!utilisons)|parce)"


def masked(text: Column) -> Column:
    """``text`` in lower case with addresses, paths, dates, ids and numbers masked and white space collapsed."""
    t = F.lower(text)
    t = F.when(t.rlike(r"://|www\.|@|(?<!\S)/"), F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"https?://\S+|www\.\S+", "<url>"), r"[\w.+-]+@[\w-]+\.[\w.]+", "<mail>"), r"(?<!\S)/[\w.-]+(?:/[\w.-]+)+", "<path>")).otherwise(t)
    n = F.regexp_replace(t, r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "<ip>")
    n = F.regexp_replace(n, r"\b\d{4}-\d\d-\d\d(?:[t ]\d\d:\d\d(?::\d\d)?(?:\.\d+)?z?)?\b|\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b", "<date>")
    n = F.regexp_replace(n, r"\b(?=[0-9a-f-]*\d)[0-9a-f][0-9a-f-]{7,}\b", "<id>")
    n = F.regexp_replace(n, r"\d+", "#")
    return F.trim(F.regexp_replace(F.when(t.rlike("[0-9]"), n).otherwise(t), r"\s+", " "))


def prose(text: Column) -> Column:
    """``text`` without fenced code, code spans, quoted lines, quoted words and lines that look like code."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"(?s)```.*?(?:```|\z)", "\n")
    t = F.regexp_replace(t, r"(?m)^[ \t]*>.*$", "")
    t = F.regexp_replace(t, r"`[^`\n]*`", " c0de ")
    t = F.regexp_replace(t, PAGE, " rawerrorpage ")
    t = F.regexp_replace(t, CODE_LINE, "")
    return t


def _rule(patterns: list[str], whole: bool = False) -> str:
    """One expression for all patterns; ``whole`` takes the open tails off, so that a phrase has to cover the statement."""
    if whole:
        patterns = ["|".join(re.sub(r"(?:\\b)?\.(?:\*|\{0,\d+\})$", "", x) for x in _alternatives(p)) for p in patterns]
    return r"(?iu)^(?:[-*•>#(]{1,3}\d{0,2}[.)]?\s+)?(?:noscript:\s*)?[¡¿]?(?:" + "|".join(patterns) + r")[\s.!?…:]*$"


def _alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern at its top level."""
    parts, depth, last = [], 0, 0
    for i, c in enumerate(pattern):
        depth += (c == "(") - (c == ")") if pattern[i - 1 : i] != "\\" else 0
        if c == "|" and depth == 0:
            parts.append(pattern[last:i])
            last = i + 1
    return [*parts, pattern[last:]]


def _count(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


# The words that frame a message in which a name varies.
HEAD_WORDS, TAIL_WORDS = 4, 3
_KEY = r"^\s*(?:t\()?['\"]?[a-z][\w-]*(?:\.[\w-]+)+['\"]?\)?[;,]?\s*$"
_HEADING = r"^\s*#{1,6}\s.*$|^\*\*[^*]+\*\*:?$|^[^:.]{1,40}:$"


def _words(s: Column) -> Column:
    return F.size(F.split(s, r"\s+"))


def statements_of(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, source, ``mask_hash``, its statements (masked hash, words, text) and what only its whole text tells; ``mask_hash`` is that of all its statements.

    Null and blank texts have no statements; a null id is kept.
    """
    d = documents.select("doc_id", F.coalesce(F.regexp_replace(F.lower(F.trim("source")), r"[\s-]+", "_"), F.lit("")).alias("src"), F.coalesce(F.col("text"), F.lit("")).alias("_ts_text")).where(F.col("_ts_text").rlike(r"\S"))
    d = d.withColumn("_ts_prose", prose(F.col("_ts_text")))
    p, text = F.col("_ts_prose"), F.col("_ts_text")
    # one look for any opening mark keeps plain prose off the single patterns
    slots = p.rlike(r"[{\[<@%«]|__|_(?:PLACE|HERE|GOES)|\$\(") & reduce(lambda a, b: a | b, [p.rlike(x) for x in SLOTS])
    cut_up = F.filter(F.transform(F.split(p, r"(?<=[.!?])\s+|\s*\n+\s*"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:\*\*\*|---?|•|\|)\s+|\s+$", ""))), lambda x: x.rlike(r"\S"))
    said = F.transform(cut_up, lambda x: F.struct(F.xxhash64(masked(x)).alias("h"), _words(x).alias("n"), x.alias("text")))
    lorem = r"(?i)\b(?:" + "|".join(LOREM) + r")\b"
    mash = r"(?i)(?<!\S)(?:" + "|".join(MASH) + r")(?!\S)"
    dead = r"\bundefined\b|\bnull\b|\bNaN\b|\[object \w+\]|\bInvalid [Dd]ate\b"
    d = d.withColumn("said", said)
    return d.select(
        "doc_id", "src", F.xxhash64(F.transform("said", lambda x: x["h"])).alias("mask_hash"), "said", slots.alias("slots"),
        _count(p, lorem).alias("lorem"), _count(p, mash).alias("mash"), _count(p, dead).alias("dead"),
        F.when(F.instr(text, "{") > 0, _count(F.regexp_replace(text, r"`[^`]*`", ""), r"(?<![\w${])\{[a-z_]+\}(?!\})")).otherwise(0).alias("braces"),
        text.rlike(r"(?m)^(?:import|export|const|function) |=>").alias("is_code"),
    )


def judged_messages(said: DataFrame, min_docs: int, min_sources: int) -> DataFrame:
    """Every message with a verdict: ``h``, its class, its words, and in how many documents it occurs.

    ``said`` has h, text and src per statement. Counted map-side before the shuffle; each message is judged once. A message
    recurs if it, or the frame of a message with a phrase (its first ``HEAD_WORDS`` or its last ``TAIL_WORDS`` words, between
    which a name may vary), is found in ``min_docs`` documents of ``min_sources`` sources.
    """
    m = said.groupBy("h").agg(F.min("text").alias("text"), F.count("*").alias("message_docs"), F.hll_sketch_agg("src").alias("sources"))
    m = m.withColumn("s", F.regexp_replace(F.regexp_replace("text", LEAD, ""), TRAIL, ""))
    s, raw = F.col("s"), F.col("text")
    wide = lambda docs, sources: (docs >= min_docs) & (F.coalesce(F.hll_sketch_estimate(sources), F.lit(0)) >= min_sources)
    narrative = s.rlike(r"(?iu)" + NARRATIVE)
    addressed = s.rlike(r"(?iu)" + CUE_READER + r"|\b(?:this|diese|esta|este) (?:page|site|app|viewer|application|seite|página|sitio)\b") & ~narrative
    # trouble with something of a page, or told to the reader; or a plea about something of a page
    thing, trouble = s.rlike("(?iu)" + CUE_THING), s.rlike("(?iu)" + CUE_TROUBLE)
    hint = (_words(s) <= 30) & ((trouble & (thing | addressed)) | (thing & s.rlike(r"(?iu)\b(?:please|bitte|veuillez|por favor)\b"))) & ~narrative & ~s.contains("c0de")
    head, stub = s.rlike(_HEADING), s.rlike(_rule(FORM_STUB))
    m = m.withColumn("opens", s.rlike(_rule(NOTICE + ERROR))).withColumn("fills", s.rlike(_rule(FILLER)))
    m = m.withColumn("recurs", wide(F.col("message_docs"), F.col("sources")))
    m = m.select(
        "h", "message_docs", "sources", "s", "recurs", _words(s).alias("words"), "opens", "fills",
        F.when(F.col("opens"), addressed | s.rlike(_rule(NOTICE + ERROR, whole=True))).when(F.col("fills"), ~narrative | s.rlike(_rule(FILLER, whole=True))).otherwise(False).alias("sure"),
        F.when(F.col("recurs"), hint).otherwise(False).alias("hint"), (s.rlike(_rule(FURNITURE)) | raw.rlike(_rule(FURNITURE))).alias("furniture"), head.alias("head"), (stub & ~head).alias("stub"), s.rlike(_KEY).alias("key"),
    ).where("opens or fills or hint or furniture or head or stub or key")
    m = cut(m)
    words = F.split(masked(F.col("s")), " ")
    frames = F.array(F.concat(F.lit("a "), F.array_join(F.slice(words, 1, HEAD_WORDS), " ")), F.concat(F.lit("z "), F.array_join(F.slice(F.reverse(words), 1, TAIL_WORDS), " ")))
    framed = m.where((F.col("opens") | F.col("fills")) & (F.size(words) > max(HEAD_WORDS, TAIL_WORDS))).select("h", "message_docs", "sources", F.explode(frames).alias("frame"))
    common = framed.groupBy("frame").agg(F.sum("message_docs").alias("n"), F.hll_union_agg("sources").alias("all")).where(wide(F.col("n"), F.col("all"))).select("frame")
    spread = framed.join(common, "frame").select("h").distinct().withColumn("framed", F.lit(True))
    m = m.join(spread, "h", "left")
    recurs = F.col("recurs") | F.col("framed").isNotNull()
    kind = (
        F.when((F.col("opens") & (F.col("sure") | recurs)) | (F.col("recurs") & F.col("hint")), "note")
        .when(F.col("furniture"), "furniture")
        .when(F.col("fills") & (F.col("sure") | recurs), "filler")
    )
    return m.select("h", "message_docs", kind.alias("kind"), "head", "stub", "key", "words").where("kind is not null or head or stub or key")


def find_residue(documents: DataFrame, min_docs: int = 3, min_sources: int = 2) -> DataFrame:
    """Documents to exclude: doc_id, kind, how often the masked text recurs (``group_docs``, ``group_sources``) and its commonest residue message (``message_docs``).

    A message that a phrase rule does not cover whole counts only if it recurs in ``min_docs`` documents of ``min_sources`` sources, or addresses
    its reader. A text with page furniture alone is excluded only if its masked form recurs so. Repeated rows with one
    doc_id count once in the result. Null or blank texts are never residue.
    """
    # the statements are used twice, by message and by document; the texts are read once
    d = statements_of(documents)
    path = scratch_path(d.sparkSession, "statements")
    d.write.parquet(path)
    d = d.sparkSession.read.parquet(path)
    key = ["doc_id", "mask_hash"]
    said = d.select(*key, "src", F.explode("said").alias("x")).select(*key, "src", "x.h", "x.n", "x.text")
    messages = judged_messages(said.select("h", "text", "src"), min_docs, min_sources)
    note = F.col("kind") == "note"
    # a hot message lies on the probing side, where adaptive execution splits it
    met = d.select(*key, F.explode("said").alias("x")).select(*key, "x.h", "x.n").join(messages, "h")
    sums = met.groupBy(*key).agg(
        F.sum(F.when(note, F.col("words")).otherwise(0)).alias("note"), F.sum(F.when(F.col("kind") == "furniture", F.col("words")).otherwise(0)).alias("furniture"),
        F.sum(F.when(F.col("kind") == "filler", F.col("words")).otherwise(0)).alias("fill"), F.count_if("head").alias("heads"), F.count_if("stub").alias("stubs"), F.count_if("key").alias("keys"),
        F.sum(F.col("n") - F.col("words")).alias("stripped"), F.max(F.when(F.col("kind").isNotNull() | F.col("stub"), F.col("message_docs"))).alias("message_docs"),
    )
    total = F.aggregate("said", F.lit(0), lambda n, x: n + x["n"])
    # rows that repeat a document multiply all its sums alike
    whole = d.groupBy(*key).agg(F.count("*").alias("rows"), F.max(F.struct("slots", "lorem", "mash", "dead", "braces", "is_code", F.size("said").alias("size"), total.alias("n"))).alias("w"))
    groups = d.groupBy("mask_hash").agg(F.count("*").alias("group_docs"), F.approx_count_distinct("src").alias("group_sources"))
    names = ("note", "furniture", "fill", "heads", "stubs", "keys", "stripped")
    some = whole.join(sums, [whole[k].eqNullSafe(sums[k]) for k in key], "left").select(*[whole[k] for k in key], "w.*", *[(F.coalesce(sums[c], F.lit(0)) / F.col("rows")).alias(f"_{c}") for c in names], F.coalesce("message_docs", F.lit(0)).alias("message_docs"))
    # a table of numbers from here on: the optimizer would try the verdict's conditions in all spellings of these columns
    some = cut(some)
    n = F.greatest(F.col("n") - F.col("_stripped"), F.lit(1))
    kind = (
        F.when(F.col("slots"), "slot")
        .when((F.col("braces") >= 2) & (F.col("braces") >= 0.1 * n) & ~F.col("is_code"), "slot")
        .when((F.col("_stubs") >= 1) & (F.col("_stubs") + F.col("_heads") >= F.col("size")) & (F.col("_heads") >= 1), "form")
        .when((F.col("_stubs") >= 2) & (F.col("_stubs") + F.col("_heads") >= 0.8 * F.col("size")), "form")
        .when(F.col("_fill") >= 0.6 * n, "filler")
        .when((F.col("lorem") >= 0.5 * n) & (F.col("lorem") >= 4), "filler")
        .when((F.col("mash") >= 0.5 * n) & (F.col("mash") >= 3), "filler")
        .when((F.col("_keys") >= 1) & (F.col("_keys") >= F.col("size")), "broken")
        .when((F.col("dead") >= 2) & (F.col("dead") >= 0.18 * n), "broken")
        .when((F.col("_note") > 0) & (F.col("_note") + F.col("_furniture") >= 0.5 * n), "notice")
        .when((F.col("_furniture") > 0) & (F.col("_furniture") + F.col("_note") >= 0.5 * n), "recurring")
    )
    # only what has a verdict meets the groups, so blank and ordinary texts that recur by the million stay out of this join
    hit = some.withColumn("kind", kind).where("kind is not null").join(groups.withColumnRenamed("mask_hash", "_ts_mask"), F.col("mask_hash") == F.col("_ts_mask"))
    hit = hit.where((F.col("kind") != "recurring") | ((F.col("group_docs") >= min_docs) & (F.col("group_sources") >= min_sources)))
    return hit.select("doc_id", "kind", "group_docs", "group_sources", "message_docs").dropDuplicates(["doc_id"])
