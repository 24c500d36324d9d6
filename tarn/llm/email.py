"""What a sender newly wrote: authored, quoted, signature and disclaimer spans of emails and notes.

A semi-Markov model labels whole runs of lines at once.  Every line has a kind (a mark, an attribution, a header
field, a closing, a contact, a notice, a short or a plain line, ...), every label scores the kinds of the lines it
covers, and on top of that a span is scored as a whole: the cue it opens with, what it may follow, its length, and
whether it runs to the end of the message, as unmarked history always does.  The best division of the message into spans is
decoded exactly; neighbouring lines of one kind move together, so messages cost in proportion to their turns.

Labels: A authored, M marked quotation, U unmarked quotation, S closing and signature, D notices.

Defined results: null and blank messages have no lines; blank lines are never reported; messages without any cue
are authored; null comments keep their number; repeated rows are decoded independently.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.sources.tables import spread

LABELS = "AMUSD"

# Closing formulas, by language.
CLOSINGS = """
best|best regards|best wishes|with best wishes|with best regards|kind regards|kindest regards|warm regards|warmest regards|regards|with kind regards|many regards|br|rgds|kr|
sincerely|yours sincerely|sincerely yours|yours|yours truly|yours faithfully|faithfully|respectfully|cheers|thanks|thank you|many thanks|thanks a lot|thanks again|thanks and regards|thanks & regards|thanks in advance|thx|tia|take care|all the best|salutations|cordially|
mit freundlichen grüßen|mit freundlichen grüssen|mit freundlichem gruß|freundliche grüße|freundliche grüsse|mit besten grüßen|beste grüße|viele grüße|liebe grüße|herzliche grüße|schöne grüße|grüße|gruß|mfg|lg|vg|vielen dank|danke|besten dank|hochachtungsvoll|
cordialement|bien cordialement|très cordialement|sincères salutations|meilleures salutations|salutations distinguées|bien à vous|bien à toi|respectueusement|amicalement|merci|merci d'avance|merci beaucoup|cdt|cdlt|bonne journée|
saludos|un saludo|saludos cordiales|un cordial saludo|cordiales saludos|atentamente|muy atentamente|cordialmente|muchas gracias|gracias|gracias de antemano|
atenciosamente|cumprimentos|com os melhores cumprimentos|melhores cumprimentos|abraços|um abraço|obrigado|obrigada|muito obrigado|muito obrigada|att|
cordiali saluti|distinti saluti|saluti|un saluto|grazie|grazie mille|
met vriendelijke groet|met vriendelijke groeten|vriendelijke groet|groeten|groet|hartelijke groet|mvg|bedankt|alvast bedankt|
z poważaniem|pozdrawiam|serdecznie pozdrawiam|pozdrowienia|dziękuję|
с уважением|с наилучшими пожеланиями|спасибо|всего доброго|
よろしくお願いします|よろしくお願いいたします|敬具|以上
"""
# How mobile programs sign, and notices that go with mails, as they begin or as they are told by.
MOBILE = r"""(?:sent|written) (?:from|via|using|with) (?:my|a|the|outlook|yahoo|proton|gmail|mail)\b[^.!?]*(?:[.!?]|excuse[^.!?]*)?$|get (?:the )?(?:outlook|mail)\b.{0,30}(?:app\b.*|for .*)$|(?:von|aus) meine[mr] .{2,30} (?:gesendet|geschickt)\.?$|gesendet (?:von|mit) .{2,40}$|envoyé (?:depuis|de|à partir de) (?:mon|ma|un|l')\s?.{2,40}$|enviado (?:desde|do|de|a partir d[oe]) (?:mi|meu|minha|un)\b.{2,40}$|inviato d(?:al mio|a)\b.{2,40}$|verzonden (?:vanaf|met|van) (?:mijn|een)\b.{2,40}$|wysłane? z .{2,40}$|отправлено с .{2,40}$"""
NOTICES = r"""
  (?:this|the|diese|dieses|ce|cet|cette|este|esta|questo|questa|dit|deze|ta|niniejsza)\s(?:(?:contents?|information)\s(?:of|in|contained\sin)\s(?:this\s)?)?(?:e-?mail|mail|message|communication|transmission|nachricht|courriel|courrier|mensaje|correo|mensagem|messaggio|bericht|wiadomość)\b.{0,60}?\b(?:confidential|privileged|intended|meant|private|solely|proprietary|vertraulich\w*|bestimmt|confidentiels?|destinée?s?|réservée?s?|confidencial\w*|destinatari\w*|riservat\w*|vertrouwelijk\w*|poufn\w*)
| (?:the\s)?(?:contents?|information)\s(?:of|in|above|contained)\b.{0,50}\b(?:meant|intended|private|confidential|privileged)
| der\sinhalt\sdieser\s(?:nachricht|e-?mail)\b | le\scontenu\sde\sce\s(?:courriel|message|mail)\b | el\scontenido\sde\seste\s(?:mensaje|correo)\b | o\sconteúdo\sdesta\smensagem\b
| (?:confidential|confidentiality|confidentiality\snotice|notice|disclaimer|legal\snotice|hinweis|vertraulich|avis|aviso(?:\slegal)?|important|privileged\s(?:and|&)\sconfidential)\s*[:–—-]\s*.{0,60}(?:mail|message|information|nachricht|courriel|mensaje|recipient|addressee|confidential|private|intended|\Z)
| if\s(?:you\sare\snot\sthe\s(?:intended|named)|you\s(?:have\s)?received?\sthis|it\sreached\syou\sby\smistake|this\s(?:e-?mail|message)\sreached) | sollten\ssie\s(?:sie|diese|nicht)\b.{0,40}(?:irrtümlich|empfänger|erhalten) | si\s(?:vous\s(?:l'avez|avez)\sreçu|lo\srecibió|usted\sno\ses|ha\srecibido)\b | se\s(?:você\srecebeu|avete\sricevuto)\b
| any\s(?:copying|use|disclosure|unauthori[sz]ed|review|dissemination)\b.{0,60}(?:prohibited|forbidden|unlawful|by\sothers)
| (?:no\scontract\sis\sformed|calls\sand\smails\smay\sbe\s(?:recorded|monitored)|(?:calls|e-?mails?)\smay\sbe\s(?:recorded|monitored)|we\saccept\sno\sliability|please\sconsider\sthe\senvironment|think\sbefore\s(?:you\s)?print|save\spaper|rates\squoted\shere\sare\sindicative)
| (?:bitte\sdenken\ssie\san\sdie\sumwelt|wir\s(?:haften\snicht|übernehmen\skeine\shaftung)|(?:die\s)?(?:unbefugte\s)?weitergabe\b.{0,40}untersagt|sitz\sder\sgesellschaft|registergericht|geschäftsführer\w*\s*:|handelsregister)
| (?:pensez\sà\sl'environnement|nous\sdéclinons\stoute|merci\sde\spenser\sà\sl'environnement|toute\s(?:diffusion|copie|utilisation)\b.{0,60}interdit\w*)
| (?:piense\sen\sel\smedio\sambiente|no\snos\shacemos\sresponsables|no\saceptamos\sresponsabilidad|declinamos\b|antes\sde\simprimir|queda\sprohibid\w*|pense\sno\smeio\sambiente|pensa\sall'ambiente|denk\saan\shet\smilieu)
| registered\s(?:office|in\sengland|number|company)\b | company\s(?:number|registration)\b | a\smember\sof\b.{0,60}\bgroup\b | virus(?:es)?\b.{0,30}\bliab
"""
GATEWAY = r"""
  \[\s*(?:external|extern|externe|externo|ext)\s*\] .* | \*{2,}\s*(?:warning|caution|external|achtung|attention|warnung|atención|aviso|avertissement)\b.*
| (?:caution|warning|attention|achtung|warnung|external\s(?:e-?mail|sender|message)|atención|aviso|avertissement|security\snotice|vorsicht)\s*[:!–-]\s*.{0,80}(?:sender|absender|extern\w*|outside|origin\w*|expéditeur|remitente|remetente|links?|attachments?).*
| (?:you\sdon['’]t\soften\s(?:get|receive)\s(?:e-?)?mail\b.* | you\sdo\snot\soften\s(?:get|receive)\b.*| some\speople\swho\sreceived\sthis\smessage.* | this\s(?:e-?mail|message|mail)\s(?:came|comes|originated|originates|was\ssent)\sfrom\s(?:outside|an?\s(?:outside|external)).* | diese\s(?:e-?mail|nachricht)\skommt\svon\s(?:außerhalb|einem\sextern).* | ce\s(?:message|courriel)\s(?:provient|vient)\sde\sl'ext.* | este\s(?:mensaje|correo)\sproviene\sde\s(?:fuera|un\sremitente\sext).*)
"""
_WROTE = r"(?:wrote|writes|schrieb|a écrit|écrit|escribió|escribio|escreveu|ha scritto|schreef|napisał(?:\(a\)|a)?|написал[аи]?|said)"
_NAME = r"[^\W\d_][\w.'’\-]*(?:\s+[^\W\d_][\w.'’\-]*){0,4}"
INTRO = rf"""
  (?:on|am|le|el|il|em|op|dnia|w\sdniu|den)\s.{{6,160}}\b{_WROTE}\b.{{0,40}}:\s*$
| {_NAME}(?:\s*<[^<>\s]+@[^<>\s]+>)?\s+{_WROTE}(?:\s(?:on|am|le|el|il|em|op)\s.{{4,40}})?\s*:\s*$
| (?:quoting|zitat\svon|citation\sde|en\sréponse\sà|citando\sa|in\sreply\sto|in\sresponse\sto)\s.{{2,100}}:\s*$
| \[?\d{{1,4}}[./-]\d{{1,2}}[./-]\d{{1,4}}[,]?\s+(?:um\s|at\s|à\s|a\slas\s)?\d{{1,2}}[:.h]\d{{2}}(?::\d{{2}})?\s*(?:[ap]\.?m\.?)?\]?\s*(?:[-–—,]|\s)\s*{_NAME}(?:\s*<[^<>\s]+@[^<>\s]+>)?\s*:\s*$
| .{{0,60}}\d{{4}}.{{0,60}}<[^<>\s]+@[^<>\s]+>\s*(?:{_WROTE})?\s*:\s*$
"""
_INTRO_OPEN = re.compile(r"^(?:on|am|le|el|il|em|op|dnia)\s.{6,160}(?:\d{1,2}[:.h]\d{2}|\d{4}|<[^<>\s]+@[^<>\s]+>).{0,80}$", re.IGNORECASE)
_INTRO_END = re.compile(rf"^(?:{_NAME}\s*)?(?:<[^<>\s]+@[^<>\s]+>\s*)?{_WROTE}\s*:\s*$", re.IGNORECASE)
BANNER = r"""[-_=*\s]{0,40}(?:original\s(?:message|appointment|e-?mail)|ursprüngliche\snachricht|originalnachricht|weitergeleitete\snachricht|message\s(?:d['’]origine|original|transféré|transmis)|(?:begin\s)?forwarded\smessage|anfang\sder\sweitergeleiteten\snachricht|mensaje\s(?:original|reenviado)|mensagem\s(?:original|encaminhada)|messaggio\s(?:originale|inoltrato)|oorspronkelijk\sbericht|doorgestuurd\sbericht|wiadomość\s(?:oryginalna|przekazana)|(?:исходное|пересылаемое)\sсообщение|début\sdu\smessage\s(?:transféré|réexpédié))[:\s]*[-_=*]*\s*$"""
FIELDS = "from|sent|to|cc|bcc|date|subject|reply-to|importance|attachments|von|gesendet|an|kopie|datum|betreff|de|envoyé|envoyé le|date|à|objet|copie|enviado|enviado el|fecha|para|asunto|cco|enviada|enviada em|data|assunto|da|inviato|a|oggetto|van|verzonden|aan|onderwerp|od|wysłano|do|dw|temat|от|отправлено|кому|тема|дата"
_HEAD = re.compile(rf"^\*{{0,2}}(?:{FIELDS})\s?:\*{{0,2}}(?:\s|$)", re.IGNORECASE)
_HEAD_DATE = re.compile(r"^\*{0,2}(?:sent|date|gesendet|datum|envoyé|envoyé le|enviado|enviado el|fecha|enviada|enviada em|data|inviato|verzonden|wysłano|отправлено|дата)\s?:\*{0,2}\s+.*(?:\d{1,2}[:.h]\d{2}|\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|[^\W\d_]{3,}\.?,? \d{1,2},? \d{4})", re.IGNORECASE)
_HEAD_PARTY = re.compile(r"^\*{0,2}(?:from|to|cc|bcc|reply-to|von|an|kopie|de|à|copie|para|cco|da|a|van|aan|od|do|dw|от|кому)\s?:\*{0,2}\s+(?P<v>.*)$", re.IGNORECASE)
_MARK = re.compile(r"^[ \t]*(?:[A-Z]{1,3}>|>(?!=(?!=))|\|(?![|]))")
_TABLE = re.compile(r"^\s*\|(?:[^|]+\|){2,}\s*$")
_ARROW = re.compile(r"^\s*(?:>=(?!=)|>\s*\d[\d.,]*\s*(?:%|[A-Z]{3}\b)|->|-->|=>)")
_RULE = re.compile(r"^\s*(?:[-–—_*=~#+.]\s?){2,}\s*$")

_closing_words = "|".join(sorted((re.escape(c.strip()).replace(r"\ ", r"\s+") for c in CLOSINGS.replace("\n", "").split("|") if c.strip()), key=len, reverse=True))
_CLOSE = re.compile(rf"^(?:{_closing_words})(?:\s*[,.!;:–—-]+\s*|$|\s+(?=\S))(?P<who>(?:\S+(?:\s+\S+){{0,5}})?)$", re.IGNORECASE)
_CAPS = re.compile(r"^(?:[A-ZÀ-ÞŁŚŻČŠŽА-Я][\w.'’\-]*|de|la|van|von|der|den|del|di|da|du|le|dos|ter|bin|al)?(?:\s+(?:[A-ZÀ-ÞŁŚŻČŠŽА-Я][\w.'’\-]*|de|la|van|von|der|den|del|di|da|du|le|dos|ter|bin|al))*$")
_MOBILE = re.compile(rf"^\s*(?:{MOBILE})", re.IGNORECASE)
_GATE = re.compile(rf"^\s*(?:{GATEWAY})\s*$", re.IGNORECASE | re.VERBOSE)
_DISC = re.compile(rf"^[\s*_]*(?:{NOTICES})", re.IGNORECASE | re.VERBOSE)
_INTRO = re.compile(rf"^[\s*]*(?:{INTRO})", re.IGNORECASE | re.VERBOSE)
_BANNER = re.compile(rf"^{BANNER}", re.IGNORECASE | re.VERBOSE)
_GREET = re.compile(r"^(?:(?:hi|hello|hey|dear|good\s+(?:morning|afternoon|evening|day)|greetings|guten\s+(?:tag|morgen|abend)|hallo|liebe[rs]?|sehr\s+geehrte[rs]?|moin|bonjour|bonsoir|salut|chère?|madame|monsieur|hola|buen[oa]s\s+(?:d[ií]as|tardes|noches)|estimad[oa]s?|olá|bom\s+dia|boa\s+(?:tarde|noite)|prezad[oa]s?|caro|cara|ciao|buongiorno|buonasera|gentile|beste|geachte|goedemorgen|goedemiddag|dzień\s+dobry|szanown[yai]|witam|здравствуйте|добрый\s+день|уважаем)\b[^.!?]{0,50}[,:!–—-]?|[^\W\d_][\w'’.\-]*(?:\s[^\W\d_][\w'’.\-]*)?\s+[-–—,:])\s*$", re.IGNORECASE)
_CONTACT = re.compile(r"^\s*(?:(?:t|m|p|f|e|w|tel|phone|mobile|mob|cell|fax|direct|office|e-?mail|mail|web|telefon|mobil|tél|téléphone|teléfono|móvil|tlf|telefone|skype)\b\s*[.:]*\s*)?(?:mailto:)?(?:[\w.+\-]+@[\w.\-]+\.\w+|<[\w.+\-]+@[\w.\-]+>|(?:https?://|www\.)\S+|[+(]?\d[\d\s().\-/]{6,}\d(?:\s*(?:ext|x|poste|durchwahl|-)\.?\s*\d+)?)\s*[,|]?\s*$", re.IGNORECASE)
_PS = re.compile(r"^\s*p\.?\s?s\.?\s*[:.\-–]?\s", re.IGNORECASE)
_POSTAL = re.compile(r"\d.*,\s*(?:[A-Z]{2}\s)?(?:\d{4,5}\s+[A-ZÀ-Þ][\w'’.\- ]*|[\w'’.\- ]+\s(?:[A-Z]{2}\s)?(?:\d{5}|[A-Z]{1,2}\d[\dA-Z]?\s\d[A-Z]{2}|[A-Z]\d[A-Z]\s\d[A-Z]\d))$")
_LISTED = re.compile(r"[-*•·+–]\s|\d+[.)]\s|\|")
_ADDRESSY = re.compile(r"\d{2}|,|\|")
_SENTENCE_END = re.compile(r"[.!?…:;][\"'”’)»*_]*$")
_FIRST = re.compile(r"[\s*_\[({\"'«“„>|-]*([^\W\d_]+)")
# The words notices, mobile signatures and gateway warnings begin with; other lines need no closer look.
_NOTICE_FIRST = frozenset(
    """this the diese dieses ce cet cette este esta questo questa dit deze ta niniejsza content contents information der le el o confidential confidentiality notice
    disclaimer legal hinweis vertraulich avis aviso important privileged if sollten si se any no calls e email mails we please think save rates bitte wir die unbefugte
    weitergabe sitz registergericht geschäftsführer geschäftsführerin geschäftsführung handelsregister pensez nous merci toute piense declinamos antes queda pense pensa denk
    registered company a virus viruses sent written get von aus gesendet envoyé enviado inviato verzonden wysłana wysłane отправлено external extern externe externo ext
    warning caution achtung attention warnung atención avertissement security vorsicht you some""".split()
)
_CLOSE_FIRST = frozenset(re.split(r"[\s']", c.strip().replace("&", " "))[0] for c in CLOSINGS.replace("\n", "").split("|") if c.strip())
_FIELD_FIRST = frozenset(f.split()[0].split("-")[0] for f in FIELDS.split("|"))
_BANNER_FIRST = frozenset("original ursprüngliche originalnachricht weitergeleitete message begin forwarded anfang mensaje mensagem messaggio oorspronkelijk doorgestuurd wiadomość исходное пересылаемое début".split())
_GREET_FIRST = frozenset("hi hello hey dear good greetings guten hallo liebe lieber liebes sehr moin bonjour bonsoir salut cher chère madame monsieur hola buenos buenas estimado estimada estimados estimadas olá bom boa prezado prezada prezados caro cara ciao buongiorno buonasera gentile beste geachte goedemorgen goedemiddag dzień szanowny szanowna szanowni witam здравствуйте добрый уважаемый уважаемая".split())
#: Kinds that can make a message anything but authored.
_CUES = frozenset("mark intro head banner rule close name contact mobile disc gate".split())

# What each label earns by a line of each kind.
_EARNS = {
    #            A     M     U     S     D
    "plain": (1.0, -4.0, 1.0, -3.5, -3.0),
    "short": (0.2, -4.0, 1.0, 0.6, -2.5),
    "greet": (1.5, -4.0, 1.5, -5.0, -4.0),
    "mark": (-7.0, 3.0, 1.0, -6.0, -6.0),
    "cont": (-1.5, 2.0, 1.0, -4.0, -4.0),
    "lead": (-6.0, 2.5, 1.0, -5.0, -5.0),
    "intro": (-6.0, 1.0, 3.0, -5.0, -5.0),
    "head": (-5.0, -2.0, 3.0, -4.0, -4.0),
    "banner": (-6.0, 0.0, 4.0, -4.0, -4.0),
    "rule": (-0.4, -1.0, 0.4, 0.4, 0.4),
    "bar": (-3.0, 0.0, 0.5, -2.0, -2.0),
    "close": (-5.0, -4.0, 2.0, 4.0, -4.0),
    "name": (-2.0, -4.0, 1.0, 2.5, -3.0),
    "contact": (-1.5, -4.0, 1.0, 2.5, -3.0),
    "mobile": (-6.0, -4.0, 2.0, 1.0, 4.0),
    "disc": (-5.0, -4.0, 2.0, -1.0, 4.0),
    "tail": (-1.0, -4.0, 1.0, -2.0, 3.0),
    "gate": (-7.0, -4.0, 2.0, -4.0, 6.0),
    "ps": (4.0, -4.0, 1.0, -6.0, -6.0),
}
# What a change from one label to another costs.
_MOVE = {
    ("A", "M"): 0.5, ("A", "U"): 0.5, ("A", "S"): 1.0, ("A", "D"): 1.0, ("M", "A"): 0.8, ("M", "U"): 1.0, ("M", "S"): 1.0, ("M", "D"): 1.0,
    ("U", "A"): 12.0, ("U", "M"): 12.0, ("U", "S"): 12.0, ("U", "D"): 12.0, ("S", "A"): 4.0, ("S", "M"): 0.5, ("S", "U"): 0.5, ("S", "D"): 0.5,
    ("D", "A"): 1.5, ("D", "M"): 0.5, ("D", "U"): 0.5, ("D", "S"): 1.5,
}
# What a span of a label can open with, and what that earns; authored spans can open with anything.
_OPENS: dict[str, dict[str, float]] = {
    "A": {},
    "M": {"mark": 0.0, "lead": 0.0, "intro": 0.0, "banner": 0.0, "bar": 0.5},
    "U": {"intro": 1.0, "head": 2.0, "banner": 3.0, "bar": 2.5},
    "S": {"close": 2.0, "rule": 1.5, "name": 0.5, "contact": -0.5, "mobile": 0.0, "short": -1.5},
    "D": {"disc": 1.0, "gate": 2.0, "mobile": 1.5, "rule": 1.5},
}


def _is_head(line: str) -> bool:
    """Whether a header field has the value it should: a date, an address or names; a subject tells nothing by itself."""
    if _HEAD_DATE.match(line):
        return True
    m = _HEAD_PARTY.match(line)
    if not m:
        return False
    v = m["v"]
    return "@" in v or (bool(v) and v[-1] != "." and all(_CAPS.match(p.strip()) for p in re.split(r"[,;]", v) if p.strip()))


@lru_cache(maxsize=100_000)
def own_kind(line: str) -> str:
    """The kind of a stripped line by itself."""
    head = line[0]
    if not head.isalnum():
        if _RULE.match(line):
            return "rule"
        if head in ">|" and _MARK.match(line) and not _TABLE.match(line) and not _ARROW.match(line):
            return "mark"
    m = _FIRST.match(line)
    first = m[1].casefold() if m else ""
    n = len(line)
    if n <= 240:
        if first in _NOTICE_FIRST and _GATE.match(line):
            return "gate"
        if first in _BANNER_FIRST and _BANNER.match(line):
            return "banner"
        if line[-1] == ":" and _INTRO.match(line):
            return "intro"
        if first in _FIELD_FIRST and _HEAD.match(line) and _is_head(line):
            return "head"
        if n <= 70 and first in _CLOSE_FIRST and (m := _CLOSE.match(line)) and (not m["who"] or _CAPS.match(m["who"].rstrip(" ,."))):
            return "close"
        if first in _NOTICE_FIRST and _MOBILE.match(line):
            return "mobile"
    if first in _NOTICE_FIRST and _DISC.match(line):
        return "disc"
    if n > 80:
        return "plain"
    if first in ("p", "ps") and _PS.match(line):
        return "ps"
    if _CONTACT.match(line) or (line[-1] != "." and _POSTAL.search(line)):
        return "contact"
    if n > 60:
        return "plain"
    if (first in _GREET_FIRST or line[-1] in "-–—,:") and _GREET.match(line):
        return "greet"
    if not _SENTENCE_END.search(line) and not _LISTED.match(line) and (n <= 30 or (n <= 45 and _ADDRESSY.search(line)) or sum(w[0].isupper() for w in line.split()) * 2 > len(line.split())):
        return "short"
    return "plain"


def kinds(lines: list[str], who: frozenset[str]) -> list[str | None]:
    """The kind of each line in its surroundings; null for blank lines."""
    bare = [ln.strip() for ln in lines]
    out: list[str | None] = [own_kind(b) if b else None for b in bare]
    n = len(out)
    for i in range(n - 1):  # attributions over two or three lines
        if bare[i] and out[i] in ("plain", "short", "contact", "head") and _INTRO_OPEN.match(bare[i]):
            if _INTRO_END.match(bare[i + 1]):
                out[i] = out[i + 1] = "intro"
            elif i + 2 < n and len(bare[i + 1]) < 80 and bare[i + 1] and _INTRO_END.match(bare[i + 2]):
                out[i] = out[i + 1] = out[i + 2] = "intro"
            elif bare[i + 1].endswith(":") and len(bare[i + 1]) < 90 and _INTRO.match(f"{bare[i]} {bare[i + 1]}"):
                out[i] = out[i + 1] = "intro"
    i = 0
    while i < n:  # header fields count as such only together or under a banner, then with any subject among them
        if out[i] != "head":
            i += 1
            continue
        j = i
        while j + 1 < n and bare[j + 1] and (out[j + 1] == "head" or (_HEAD.match(bare[j + 1]) and len(bare[j + 1]) < 160)):
            j += 1
        while i and bare[i - 1] and out[i - 1] == "plain" and _HEAD.match(bare[i - 1]) and len(bare[i - 1]) < 160:
            i -= 1
        real = out[i : j + 1].count("head")
        above = next((out[k] for k in range(i - 1, -1, -1) if out[k]), None)
        for k in range(i, j + 1):
            out[k] = "head" if real >= 2 or above == "banner" else "plain"
        i = j + 1
    for i in range(n):  # an attribution leads marked lines or opens unmarked history; a rule right above either belongs to it
        after = next((k for k in out[i + 1 : i + 4] if k), None)
        if out[i] == "rule" and after in ("head", "banner", "intro"):
            out[i] = "bar"
    for i in range(n - 1, -1, -1):
        if out[i] == "intro" and next((k for k in out[i + 1 : i + 4] if k), None) in ("mark", "lead"):
            out[i] = "lead"
    last: str | None = None
    for i in range(n):
        k = out[i]
        if k in ("plain", "short", "greet", "contact") and i and bare[i - 1]:
            before = bare[i - 1]
            if last in ("mark", "cont") and not (_SENTENCE_END.search(before) and before[-1] in ".!?") and len(before) >= 40:
                k = out[i] = "cont"  # the mail program wrapped a marked line
            elif last in ("disc", "tail"):
                k = out[i] = "tail"
        if k in ("short", "plain", "contact") and who and len(bare[i]) <= 60:
            tokens = re.findall(r"[^\W\d_]+", bare[i].casefold())
            if tokens and all(t in who for t in tokens):
                k = out[i] = "name"
        last = k
    return out


def decode(kinds_of: list[str | None]) -> list[str | None]:
    """The label of each non-blank line under the best division into spans."""
    rows = [(i, k) for i, k in enumerate(kinds_of) if k]
    if not rows:
        return [None] * len(kinds_of)
    # Neighbouring lines of one kind move together, save those a span may end or begin within.
    blocks: list[list[int]] = []
    for r, (i, k) in enumerate(rows):
        if r and k == rows[r - 1][1] and k in ("plain", "mark", "head", "tail", "cont") and i == rows[r - 1][0] + 1:
            blocks[-1][1] = r + 1
        else:
            blocks.append([r, r + 1])
    n = len(blocks)
    firsts = [rows[a][1] for a, _ in blocks]
    gap = [a > 0 and rows[a][0] > rows[a - 1][0] + 1 for a, _ in blocks]  # a blank line before the block
    opens = [[li for li in range(5) if not li or firsts[i] in _OPENS[LABELS[li]]] for i in range(n)]
    # best[j]: the best division of the blocks before j whose last span has a label: (score, where that span starts, label before it).
    best: list[dict[str, tuple[float, int, str | None]]] = [{} for _ in range(n + 1)]
    # Open spans of a label differ by a constant from block to block, so of each only the best need go on: (score so far, start, before).
    # Signatures differ until the charge for length sets in for both, and one that opens with a rule until it has a second block.
    went: list[tuple[float, int, str | None] | None] = [None] * 5
    young: list[tuple[float, int, str | None]] = []
    ruled: tuple[float, int, str | None] | None = None
    sums = [0.0] * 5
    for i, (a, z) in enumerate(blocks):  # block i ends the spans before it, begins new ones and lengthens those that are open
        first, before = firsts[i], best[i]
        for li in opens[i]:
            lab = LABELS[li]
            if i:
                if lab in before and len(before) == 1:
                    continue
                came, prev = max((p - _MOVE[q, lab], q) for q, (p, _, _) in before.items() if q != lab)
            else:
                came, prev = 0.0, None
            start = came + (_OPENS[lab][first] if li else 0.0) - sums[li]
            if lab == "S":
                if first in ("short", "name", "contact") and i and not gap[i]:
                    start -= 2.0
                if i == 0 and first not in ("close", "rule"):
                    start -= 2.0
                young.append((start, i, prev))
            elif lab == "D" and first == "rule":
                ruled = (start, i, prev)
            elif went[li] is None or start > went[li][0]:
                went[li] = (start, i, prev)
        for li, got in enumerate(_EARNS[first]):
            sums[li] += got * (z - a)
        ends, j = best[i + 1], i + 1
        for li in range(5):
            if li == 3:
                continue
            lab, top = LABELS[li], went[li]
            if ruled and li == 4:
                if top is None or ruled[0] - 3.0 > top[0]:  # a rule alone is hardly a notice
                    ends[lab] = (ruled[0] - 3.0 + sums[li], ruled[1], ruled[2])
                else:
                    ends[lab] = (top[0] + sums[li], top[1], top[2])
                if top is None or ruled[0] > top[0]:
                    went[li] = ruled
                ruled = None
            elif top is not None:
                ends[lab] = (top[0] + sums[li] + ((3.0 if j == n else -6.0) if lab == "U" else 0.0), top[1], top[2])
        last = 0.8 if j == n else 0.0
        old = went[3]  # its score leaves out the charge for the lines up to its start
        if old is not None:
            ends["S"] = (old[0] + 5.6 - 0.7 * z + sums[3] + last, old[1], old[2])
        kept = []
        for s in young:
            lines = z - blocks[s[1]][0]
            score = s[0] + sums[3] + last
            if lines > 8:
                score -= (lines - 8) * 0.7
                key = s[0] + 0.7 * blocks[s[1]][0]
                if went[3] is None or key > went[3][0]:
                    went[3] = (key, s[1], s[2])
            else:
                kept.append(s)
                if lines == 1 and firsts[s[1]] == "rule":
                    score -= 3.0
            if "S" not in ends or score > ends["S"][0]:
                ends["S"] = (score, s[1], s[2])
        young = kept
    out: list[str | None] = [None] * len(kinds_of)
    j, lab = n, max(best[n], key=lambda x: best[n][x][0])
    while j > 0:
        _, i, prev = best[j][lab]
        for r in range(blocks[i][0], blocks[j - 1][1]):
            out[rows[r][0]] = lab
        j, lab = i, prev or "A"
    return out


def label_lines(text: str | None, author: str | None = None) -> list[str | None]:
    """The label of each line of a message; null for blank lines."""
    if not text or not text.strip():
        return []
    lines = text.split("\n")
    who = frozenset(re.findall(r"[^\W\d_]+", re.sub(r"<[^>]*>|\S+@\S+", " ", author).casefold())) if author else frozenset()
    ks = kinds(lines, who)
    if _CUES.isdisjoint(ks):
        return ["A" if k else None for k in ks]
    return decode(ks)


def new_text(text: str | None, author: str | None = None) -> str | None:
    """The message without what its sender did not newly write."""
    if text is None:
        return None
    keep = [ln for ln, lab in zip(text.split("\n"), label_lines(text, author), strict=False) if lab in (None, "A")]
    return re.sub(r"\n\s*\n\s*\n+", "\n\n", "\n".join(keep)).strip()


LINES = "rec_id bigint, comment_no int, line_no int, label string"


def _messages(tickets: DataFrame) -> DataFrame:
    return tickets.select("rec_id", "created_by", "body", F.transform("comments", lambda c: F.struct(c["author"].alias("author"), c["body"].alias("body"))).alias("comments"))


def other_lines(tickets: DataFrame) -> DataFrame:
    """Every non-blank line that is not newly written: ``rec_id, comment_no, line_no, label``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rec, no, line, labs = [], [], [], []
                for row, by, body, comments in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    for k, (who, text) in enumerate([(by, body), *((c["author"], c["body"]) if c else (None, None) for c in comments or [])]):
                        for i, lab in enumerate(label_lines(text, who)):
                            if lab is not None and lab != "A":
                                rec.append(row)
                                no.append(k)
                                line.append(i + 1)
                                labs.append(lab)
                yield pa.RecordBatch.from_arrays([pa.array(rec, pa.int64()), pa.array(no, pa.int32()), pa.array(line, pa.int32()), pa.array(labs, pa.string())], names=["rec_id", "comment_no", "line_no", "label"])

    return spread(_messages(tickets)).mapInArrow(run, LINES)


NEW = "rec_id bigint, comment_no int, new_text string"


def reduced(tickets: DataFrame) -> DataFrame:
    """Each message with only what its sender newly wrote: ``rec_id, comment_no, new_text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                out = []
                for row, by, body, comments in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    out.append((row, 0, new_text(body, by)))
                    out += [(row, k, new_text(c["body"], c["author"]) if c else None) for k, c in enumerate(comments or [], 1)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.string()), strict=True)], names=["rec_id", "comment_no", "new_text"])

    return spread(_messages(tickets)).mapInArrow(run, NEW)
