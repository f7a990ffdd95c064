"""Template residue, filler, error pages and scripts-required notices.

Lines of all records are normalised (white space, case, digits) and counted by host, here the run a block belongs to. A line that recurs
over the records of a host, or over hosts, is boilerplate (portal bars, cookie notices, page counters, running heads), whatever its
length, and is subtracted where it stands by itself, not inside a running paragraph. A boilerplate line that holds evidence is
subtracted only if it stands in most records of the host: then it is the host's furniture and says nothing of the record. What is
left of a record, its residual, is judged: an unfilled placeholder anywhere in it is residue; filler, error messages and
scripts-required notices count if the residual consists of them, so that real text which mentions or quotes one stays. A record
of nothing but boilerplate is judged as it is, and so is one whose message has lost a line of its own to the subtraction: the kinds that
a text must consist of throughout hold for the whole text, too.

The flags a record carries aren't used. Defined cases. Null and blank texts, symbol-only, digit-only and single-letter texts are no
cases. Repeated rows are judged each; null hosts form one host. Only the named columns are read, so extra columns can't
clash. An empty table gives an empty result.

Lines are counted by two hashes of together 96 bits, so no text is shuffled for the counts. Counts are aggregated by (host, line) before
anything is joined; lines go back to their records by a shuffled join, whose hot keys adaptive execution splits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS, let
from ..session import materialize

#: A normalised line is boilerplate in a host if it stands in so many of its records, and everywhere if it stands in records of so many
#: hosts, which are also this share of all: a share, so that a line isn't boilerplate only because the corpus is large.
HOST_RECORDS = 3
HOSTS, HOSTS_SHARE = 5, 0.001
#: A line that holds evidence is a host's furniture if it stands in so many records of it, and in this share of all of them.
FURNITURE_RECORDS, FURNITURE_SHARE = 5, 0.5

# Placeholder syntaxes of common template languages; a name inside, no comma (so that {a, b, c} isn't one).
_NAME = r"\s*[\p{L}_][\p{L}\p{Nd}_.]*(?:[ \-:|][\p{L}\p{Nd}_.]+){0,5}\s*"
PLACEHOLDERS = (
    r"\{\{\{?" + _NAME + r"\}\}",
    r"[$#@%]\{" + _NAME + r"\}",
    r"(?<![\w{])\{" + _NAME + r"\}(?![\w}])",
    rf"<%[=\-#]?{_NAME}-?%>",
    rf"<<{_NAME}>>",
    rf"\[\[{_NAME}\]\]",
    r"\$\$[\p{L}_][\w.]+\$\$",
    r"@@[\p{L}_][\w.]+@@",
    r"\x{AB}[A-Za-z_]\w*(?:\.\w+)*\x{BB}",
    r"(?<!\w)__[\p{L}][\w.]*?__(?!\w)",
    r"%\([\p{L}_][\w.]*\)[sdfr]?",
    r"(?<![\w%])%[A-Z][A-Z_]{2,}%",
    r"(?<!\w)(?:TBD|TO BE (?:CONFIRMED|COMPLETED|DETERMINED)|T\.B\.[CD]\.)(?!\w)",
    r"\b(?:dd[/.-]mm[/.-]yy(?:yy)?|yyyy-mm-dd)\b",
)
# Words that open an instruction to fill in, and nouns of what is to be filled in, in brackets.
_DO = (
    "insert|enter|fill in|add|type|your|click|choose|select|please|here|put|complete|specify|provide|state|"
    "eintragen|einfügen|eingeben|einsetzen|ausfüllen|hier|bitte|ergänzen|ihr|ihre|"
    "saisir|saisissez|insérer|insérez|compléter|indiquer|indiquez|remplir|ajouter|ici|votre|"
    "insertar|inserte|escriba|escribir|introduzca|introducir|indique|indicar|rellenar|completar|aquí|su|"
    "inserire|inserisci|indicare|compilare|qui|inserir|insira|preencher|digite|aqui|invullen|invoegen|vul|hier|uw|"
    "вставить|вставьте|указать|введите|вписать|вставити|введіть|вкажіть"
)
_WHAT = (
    "name|date|address|amount|company|recipient|reference|title|number|signature|department|phone|email|client|customer|"
    "datum|betrag|empfänger|empfängers|anschrift|firma|nom|montant|destinataire|adresse|société|"
    "nombre|fecha|importe|destinatario|dirección|empresa|nome|data|importo|indirizzo|valor|naam|bedrag|adres|имя|дата|сумма|ім'я"
)
BRACKETED = (
    rf"[\[<(](?=[^\[\]<>()]{{3,60}}[\]>)])(?:[^\[\]<>()]*(?<!\p{{L}}))??(?:{_DO})(?!\p{{L}})(?=[^\[\]<>()]*\p{{L}})[^\[\]<>()]*[\]>)]",
    rf"[\[<](?:\p{{L}}+ ){{0,3}}(?:{_WHAT})(?: \p{{L}}+){{0,3}}[\]>]",
)

# How sentences of error pages begin.
_THING = (
    r"(?:requested |desired )?(?:page|document|file|site|website|viewer(?: page)?|folder|link|address|url|resource|server|service|archive|portal|content|item|application|app)"
    r"(?: page)?(?: (?:that )?you(?: have|'re| are)? (?:requested|looking for|trying to \w+))?"
)
_GONE = (
    r"(?:could not|couldn't|cannot|can't|can not) be (?:found|loaded|displayed|reached|opened|shown|located)|(?:has been|was) (?:moved|deleted|removed)|"
    r"is no longer available|no longer exists?|failed to load|(?:does not|doesn't) exist|(?:has )?expired|"
    r"is (?:temporarily |currently )?(?:down|unavailable|not available|not responding|under maintenance)|was not found|is not found|timed out"
)
_PHRASE = (
    r"(?:page|file|document|file or directory|resource|url)? ?not found|forbidden|bad gateway|gateway time-?out|(?:service|site|server)(?: is)? (?:temporarily )?unavailable|internal (?:server )?error|"
    r"bad request|unauthori[sz]ed|(?:the server|server) (?:returned|sent) an? \w+ response|server error|too many requests|access (?:is )?denied|permission denied|request (?:blocked|timed out|failed|rejected)|"
    r"method not allowed|payload too large|conflict|gone|proxy error|connection (?:timed out|refused|reset|closed|failed|lost)"
)
_TAIL = r"(?:[ ,:;-]*(?:reference|ref|incident|id|code|error|after|request|at|on|nginx|apache|proxy|gateway|server|cloud|\(|#|\d)[^.]{0,40})?"
ERRORS = (
    rf"\A(?:oops|sorry|we're sorry|we are sorry|unfortunately|whoops|uh-oh|apologies)[,!:. ]+.{{0,60}}(?:{_GONE}|wrong|error)",
    rf"\A(?:this|the|your|that) {_THING}.{{0,12}}?\s(?:{_GONE})",
    rf"\A(?:your )?session (?:has |is )?(?:expired|timed out|ended)",
    rf"\A(?:http )?(?:status|error|fehler|erreur|errore|erro|fout|ошибка|помилка|σφάλμα|error code|error http|código de error)(?: code)? ?[:#]? ?\d{{3,5}}(?!\d)(?: ?[:\-–(].*)?.{{0,70}}\z",
    rf"\A(?:http |error |status )?[1-5]\d\d\)?[ :\-–|]*(?:{_PHRASE}){_TAIL}\W*\z",
    rf"\A(?:\d+ )?(?:{_PHRASE}){_TAIL}\W*\z",
    r"\A(?:fatal |unexpected |unknown |unhandled )?error (?:establishing|loading|opening|connecting|while|occurred|reading|fetching)",
    r"\A(?:an |a )?(?:unexpected |unknown |internal )?error (?:has )?occurred",
    r"\Atraceback\b|\Aexception in|\Aunhandled exception|\Astack trace|\Asomething went wrong|\Athat's an error|\Afailed to (?:load|fetch|open|connect)|\Aunable to (?:load|connect|display|open|reach)",
    r"\Acould not (?:load|connect|open|reach)|\A(?:we )?(?:could not|couldn't|can't|cannot) (?:find|load|display|open|reach) (?:this|the|that|your) (?:page|document|file|site|viewer|folder|address)",
    r"\A(?:you do not|you don't) have permission",
    # other languages: fixed values
    r"\A(?:die )?(?:angeforderte )?(?:seite|datei|adresse|dokument)(?: \w+)? (?:nicht gefunden|existiert nicht|konnte nicht|wurde nicht|ist nicht)|\A(?:das|die|der) (?:angeforderte )?(?:dokument|datei|seite|adresse|link|server|dienst|dienste?)(?: ist)?(?: \w+)? (?:existiert nicht|konnte nicht|nicht (?:gefunden|erreichbar|verfügbar)|wurde nicht)",
    r"\A(?:zugriff|zugang) verweigert|\Ainterner (?:server)?fehler|\A(?:der )?dienst (?:ist )?(?:\w+ )?nicht|\Aseite nicht gefunden|\Aihre sitzung ist abgelaufen|\Azu viele anfragen|\Averbindung (?:fehlgeschlagen|abgebrochen)|\Azeitüberschreitung",
    r"\Apage introuvable|\Aaccès (?:refusé|interdit)|\Aservice (?:momentanément |temporairement )?indisponible|\Aerreur (?:interne|du serveur|de connexion)|\A(?:le|la) (?:fichier|lien|document|page|adresse)(?: demandée?)? n'(?:existe|a pas pu|est (?:pas|plus))|\Avotre session a expiré|\Atrop de requêtes|\Adélai (?:d'attente )?dépassé",
    r"\Apágina no encontrada|\Aacceso (?:denegado|prohibido)|\Aservicio no disponible|\Aerror (?:interno|del servidor|de conexión)|\A(?:el|la) (?:enlace|archivo|documento|página|dirección)(?: solicitad[oa])? (?:ya )?no (?:existe|se (?:ha podido|pudo)|está)|\Asu sesión ha (?:caducado|expirado)|\Ademasiadas solicitudes|\Atiempo de espera agotado",
    r"\Apagina non trovata|\Aaccesso (?:negato|vietato)|\Aservizio (?:temporaneamente )?non disponibile|\Aerrore (?:interno|del server|di connessione)|\A(?:il|la) (?:file|documento|pagina|collegamento)(?: richiest[oa])? non (?:esiste|è|può)",
    r"\Apágina não encontrada|\Aacesso (?:negado|proibido)|\Aserviço (?:temporariamente )?indisponível|\Aerro (?:interno|do servidor)|\A(?:o|a) (?:ficheiro|arquivo|documento|página)(?: solicitad[oa])? (?:já )?não (?:existe|foi|está)",
    r"\Apagina niet gevonden|\Atoegang geweigerd|\Ainterne serverfout|\A(?:de )?(?:dienst|service) is .{0,20}niet (?:beschikbaar|bereikbaar)|\A(?:het|de) (?:bestand|document|pagina) (?:bestaat niet|kon niet)",
    r"\A(?:страница|файл|документ) не найден|\Aдоступ (?:запрещ[её]н|закрыт)|\Aвнутренняя ошибка|\Aслужба (?:временно )?недоступна|\Aсервис (?:временно )?недоступен",
    r"\A(?:сторінку|файл|документ) не знайдено|\Aдоступ заборонено|\Aвнутрішня помилка|\A(?:служба|сервіс) (?:тимчасово )?недоступн",
    r"\Aη σελίδα δεν βρέθηκε|\Aδεν επιτρέπεται η πρόσβαση|\Aη υπηρεσία δεν είναι|\Aσφάλμα διακομιστή",
    r"\Aالصفحة غير موجودة|\Aتم رفض الوصول|\Aالخدمة غير متاحة|\Aخطأ في الخادم",
    r"\A(?:页面|网页|文件)(?:不存在|未找到|无法)|\A找不到(?:页面|文件)|\A(?:访问|拒绝访问)被?拒绝|\A服务(?:暂时)?不可用|\A(?:内部)?服务器错误",
    r"\Aページが見つかりません|\Aアクセスが拒否|\Aサーバー(?:内部)?エラー|\Aサービスは?(?:一時的に)?利用できません",
)
# A script word together with a word of demand or lack, in a sentence that addresses the reader or the page at hand.
_SCRIPT = r"java ?script|scripts?|scripting|skripte?n?|скрипт\w*"
_DEMAND = (
    r"enabl|turn|activat|switch|allow|requir|need|disabl|block|support|works best|could not run|aktivier|benötig|ausgeschaltet|deaktivier|einschalt|erforderlich|blockier|"
    r"activ|activez|désactiv|exige|nécessaire|requis|bloqué|necesita|desactivad|habilit|requiere|attiv|disattiv|richied|necessari|ativ|desativ|bloque|schakel|uitgeschakeld|vereist|nodig|"
    r"включ|отключ|требу|увімк|вимк|потрібн|ενεργοποι|απενεργοποι|απαιτ|تفعيل|تمكين|启用|开启|需要|禁用|有効|無効|必要"
)
_ADDRESS = (
    r"\A(?:<noscript>|please|to (?:use|view|open|continue|see|run|read|display|proceed)|your browser|(?:this|the) (?:page|app|application|site|viewer|document|website|web page|portal|window|archive)|"
    r"you (?:need|must|have)|(?:java ?script|scripts?|scripting) (?:is|are|must|has|have|needs?)|turn on|enable|activate|switch on|allow|we could not|unable|it (?:looks|seems)|"
    r"bitte|in ihrem|ihr browser|für diese|um diese|diese|aktivieren|zum|java ?script (?:ist|wird|muss)|skripte sind|"
    r"cette|veuillez|activez|ce|votre|pour|merci|java ?script (?:est|doit)|les scripts|"
    r"este|esta|active|habilite|para|su navegador|por favor|java ?script (?:está|es|debe)|los scripts|"
    r"questo|questa|per|attiva|il (?:suo|tuo) browser|ative|o seu navegador|seu|deze|dit|schakel|zet|uw browser|"
    r"включите|для|пожалуйста|ваш браузер|в вашем|увімкніть|будь ласка|у вашому|παρακαλ|για να|ο περιηγητής|يرجى|请|您的|本|この|ブラウザ|java ?scriptを)"
)
SCRIPTS = (
    rf"\A(?=.*(?<!\p{{L}})(?:{_SCRIPT})(?!\p{{L}}))(?=.*(?:{_DEMAND})){_ADDRESS[2:]}.{{0,190}}\z",
    r"\A(?:<noscript>|loading (?:the )?\w+$|if nothing happens)",
    r"\A(?:[^ ]{0,40})(?:javascript|脚本|スクリプト)(?=.*(?:启用|开启|需要|禁用|有効|無効|必要))",
)
# Sentences that go with the above but are no evidence alone.
COMPANIONS = (
    r"\A(?:please )?(?:try again|reload|refresh|check your|change the setting|turn on|go back|return to|sign in|log in|contact|if this keeps|if the problem|you do not have permission|you don't have permission|incident|reference|request id|error id|the requested|the link)",
    r"\A(?:this|the|your) .{0,60}(?:administrator|support|later|moment)|\Athis (?:page|document|file) (?:will|may)",
    r"\A(?:zurück|bitte|retour|veuillez|volver|vuelva|inténtelo|intente|riprov|torna|tente|voltar|probeer|terug|попробуйте|повторите|вернит|спробуйте|поверн)",
    r"\A(?:oops|sorry|whoops|uh-oh|unfortunately|error|warning|notice)\W*\z",
    r"\A(?:document|page|file|item) \d+ (?:of|/) \d+\W*\z|\A[\w ]{2,20}(?: [|\x{B7}>/] [\w ]{2,20})+\W*\z|\A(?:\w+ )?(?:viewer|portal|archive(?: portal)?|home|help|search|login|menu)\W*\z",
    r"\A(?:nginx|apache|iis|proxy|gateway|cloud)\b.{0,20}\z|\A\W*\z|\A[\d\s#:.-]+\z|\Aloading\b.{0,30}\z|\A</?noscript>\z",
    r"\A(?:die|das|der) (?:angeforderte )?(?:adresse|datei|dokument|seite)|\A(?:le|la|l') ?(?:fichier|lien|document|page|adresse)|\A(?:el|la) (?:enlace|archivo|documento|página|dirección)|\A(?:in ihrem|your browser|votre navigateur|su navegador)",
)
FILLERS = (
    r"\A(?:this is |dies ist |ceci est |esto es |questo è |este é |dit is )?(?:a |an |ein |eine |un |une |een |some |the )?(?:sample|dummy|filler|placeholder|example|test|blind|muster|platzhalter|füll|beispiel|faux|fictif|voorbeeld)[ -]?(?:text|texte|copy|content|paragraph|sentence|body|satz|absatz)\b",
    r"\A(?:texte|texto|testo|tekst|text) (?:de |di |d'|of )?(?:relleno|remplissage|ejemplo|exemple|prueba|essai|muestra|segnaposto|esempio|prova|preenchimento|exemplo|voorbeeld|opvulling)\b",
    r"\A(?:body|main|final|more|your|the|full) ?(?:copy|text|content|paragraph|wording)(?: (?:goes|will|is|comes))? (?:to follow|here|to come|follows|go here|goes here)",
    r"\A(?:type|write|enter|add|put|place|insert|click)(?: to add| to edit| here)? (?:your |a |the |some |an )?(?:title|text|paragraph|subtitle|summary|recommendation|heading|content|description|notes?|wording|conclusion|introduction|findings|image|caption|name|date|body|bullet)\b(?: (?:of|here|and|to|for|text)\b.{0,60})?\W*\z",
    r"\A(?:click|tap|double-click|klicken|cliquez|haga clic) .{0,12}(?:to|um|pour|para) (?:add|edit|insert|hinzu|ajouter|agregar|añadir|bearbeiten|modifier|editar)",
    r"\A(?:hier steht|hier kommt|hier ihren|ihr text|geben sie hier|saisissez (?:ici |votre )|votre texte|écrivez (?:ici|votre)|escriba (?:aquí|su)|su texto|aquí va|scrivi qui|inserisci (?:qui|il)|il tuo testo|escreva aqui|o seu texto|typ hier|uw tekst|введите (?:здесь|текст)|ваш текст|тут буде текст|在此输入|此处输入|ここに)",
    r"\A(?:heading|title|subtitle|überschrift|titre|título|titolo) ?\d*(?: (?:heading|title|text|\d+))* *(?:text|lorem)\b.{0,40}\z|\A(?:text|tekst|texto|texte|testo)(?: (?:text|tekst|texto|texte|testo)){2,}",
    r"\A(?:asdf|qwer|jkl|asd|foo|bar|blah|bla|xxx+|abc|test|etc)(?:[ ,]+(?:asdf|qwer|qwerty|jkl|asd|foo|bar|baz|blah|bla|x+|abc|test|etc)){2,}\W*\z",
    r"\A(?:это )?(?:текст-заполнитель|пример текста|образец текста)|\A(?:це )?(?:текст-заповнювач|зразок тексту)|\A(?:示例文本|占位文本|样本文字)|\A(?:ダミーテキスト|サンプルテキスト)|\Aκείμενο (?:δείγμα|υποκατάστα)|\Aنص (?:تجريبي|نموذجي)",
)
# The vocabulary of the customary pseudo-Latin filler.
LOREM = (
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint "
    "occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum"
).split()
#: Words of the pseudo-Latin that are common in other languages; a sentence needs others too.
LOREM_COMMON = "sit sed do ut et ad ex ea in eu non qui id est elit magna nulla minim".split()


def joined(text: Column, over_blank: bool = False) -> Column:
    """The text as one line: words broken over lines, with over_blank also over blank ones, are mended, other line ends become spaces."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<=\p{L})[-\x{AD}\x{2010}\x{AC}][ \t]*\r?\n" + (r"[ \t\r\n]*" if over_blank else r"[ \t]*") + r"(?=\p{Ll})", "")
    return F.trim(F.regexp_replace(t, f"[{WS}]+", " "))


def _any(c: Column, patterns: tuple[str, ...], flags: str = "(?iu)") -> Column:
    return reduce(lambda a, b: a | b, [c.rlike(flags + p) for p in patterns])


def has_placeholder(line: Column) -> Column:
    """An unfilled placeholder, or an instruction in brackets to fill one in."""
    return _any(line, PLACEHOLDERS, "(?u)") | _any(line, BRACKETED, "(?iu)")


def sentences(line: Column) -> Column:
    """Sentences of a lower-cased line, without blank ones; a portal bar or page counter at its head is one of its own."""
    line = F.regexp_replace(line, r"\A((?:document|page|file|item) \d+ (?:of|/) \d+|(?:archive )?(?:viewer|portal)|[\w ]{2,12}(?: \| [\w]{2,12})+) ", "$1" + chr(1))
    marked = F.regexp_replace(line, r"(?<=[.!?]) +|(?<=[\x{3002}\x{FF01}\x{FF1F}]) *|(?<=\.\.\.) *|\x{2026} *", chr(1))
    return F.filter(F.transform(F.split(marked, chr(1)), lambda s: F.trim(s)), lambda s: s != "")


def is_lorem(sentence: Column) -> Column:
    ws = F.regexp_extract_all(sentence, F.lit(r"\p{L}+"), F.lit(0))
    pool, common = F.array(*map(F.lit, LOREM)), F.array(*map(F.lit, LOREM_COMMON))
    known = F.filter(ws, lambda w: F.array_contains(pool, w))
    telling = F.filter(F.array_except(known, common), lambda w: w != "")
    return (F.size(ws) >= 2) & (F.size(known) >= 0.7 * F.size(ws)) & (F.size(telling) >= 1)


def is_repetition(sentence: Column) -> Column:
    """Four or more words of at least three letters, of at most half as many kinds, nothing else."""
    ws = F.regexp_extract_all(sentence, F.lit(r"\p{L}+"), F.lit(0))
    only = ~sentence.rlike(r"[\p{Nd}:|/@]")
    return only & (F.size(ws) >= 4) & (F.size(F.array_distinct(ws)) * 2 <= F.size(ws)) & F.forall(ws, lambda w: F.char_length(w) >= 3)


def _either(patterns: tuple[str, ...]) -> str:
    """All the anchored patterns as one, past leading signs: one match a sentence instead of dozens."""
    return r"(?iu)\A[^\p{L}\p{Nd}<]*+(?:" + "|".join("(?:" + p.replace("\\A", "") + ")" for p in patterns) + ")"


def kind_of(sentence: Column) -> Column:
    """'error', 'script', 'filler', 'with' (goes with the former) or null, of a lower-cased sentence."""
    return (
        F.when(sentence.rlike(_either(SCRIPTS)), F.lit("script"))
        .when(sentence.rlike(_either(ERRORS)), F.lit("error"))
        .when(sentence.rlike(_either(FILLERS)) | is_lorem(sentence) | is_repetition(sentence), F.lit("filler"))
        .when(sentence.rlike(_either(COMPANIONS) + r"|\A\W*\z"), F.lit("with"))
    )


def text_lines(text: Column) -> Column:
    """The lines of a text that are not blank, as they are."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.regexp_replace(x, f"[{WS}]+", "") != "")


def normal_lines(text: Column) -> Column:
    """The same lines normalised: lower case, runs of white space as one blank, runs of digits as 9."""
    flat = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), rf"[{WS}&&[^\n]]+", " ")
    return F.filter(F.transform(F.split(F.regexp_replace(flat, r"\p{Nd}+", "9"), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def _hashed(line: Column) -> Column:
    """96 bits for a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def boilerplate(df: DataFrame, host: str = "run_id", record: str = "ocr_id") -> DataFrame:
    """host, a, b (the hash of a line), furniture: the lines that are boilerplate in the records of a host."""
    lines = df.select(F.col(host).alias("host"), F.explode(F.array_distinct(normal_lines(F.col("text")))).alias("line"))
    by_host = lines.select("host", _hashed(F.col("line")).alias("h")).select("host", "h.*").groupBy("host", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    by_host = materialize(by_host, "host-lines")  # used three times
    least = max(HOSTS, df.select(host).distinct().count() * HOSTS_SHARE)
    recurs = by_host.groupBy("a", "b").agg(F.count(F.lit(1)).alias("hosts")).where(F.col("hosts") >= least).select("a", "b", F.lit(True).alias("everywhere"))
    records = df.where(F.length("text") > 0).groupBy(F.col(host).alias("of")).agg(F.count(F.lit(1)).alias("records"))
    often = by_host.where(F.col("n") >= FURNITURE_RECORDS)
    often = often.join(records, F.col("host").eqNullSafe(F.col("of"))).where(F.col("n") >= F.col("records") * FURNITURE_SHARE)
    often = often.select("host", "a", "b", F.lit(True).alias("furniture"))
    plain = by_host.join(recurs, ["a", "b"], "left").where(F.col("everywhere").isNotNull() | (F.col("n") >= HOST_RECORDS))
    plain = plain.select("host", "a", "b", F.lit(False).alias("furniture"))
    return plain.unionByName(often).groupBy("host", "a", "b").agg(F.max("furniture").alias("furniture"))


def gone_lines(df: DataFrame, host: str = "run_id", record: str = "ocr_id") -> DataFrame:
    """gid, gone: of each record of several lines the hashes of its lines that are boilerplate, and whether furniture."""
    some = df.where(F.contains("text", F.lit("\n"))).select(F.col(record).alias("gid"), F.col(host).alias("gh"), F.explode(F.array_distinct(normal_lines(F.col("text")))).alias("line"))
    some = some.select("gid", "gh", _hashed(F.col("line")).alias("h")).select("gid", "gh", F.col("h.a").alias("ga"), F.col("h.b").alias("gb"))
    known = boilerplate(df, host, record)
    on = F.col("gh").eqNullSafe(F.col("host")) & (F.col("ga") == F.col("a")) & (F.col("gb") == F.col("b"))
    return some.join(known, on).groupBy("gid").agg(F.collect_set(F.struct("a", "b", "furniture")).alias("gone"))


# How a line ends that another one may go on with, and how a line begins that goes on with another.
_RUNS_ON = r"[\p{L}\p{Nd},;:\-\x{AD}\x{2010}\x{AC}]\z"
_GOES_ON = r"\A\P{L}{0,2}\p{Ll}"


def residual(text: Column, gone: Column) -> Column:
    """The lines of a text without those that are boilerplate; all of them if nothing else is there."""

    def cut(x: Column) -> Column:
        raw, norm, out = x["raw"], x["norm"], x["out"]

        def stays(line: Column, i: Column) -> Column:
            h = _hashed(F.element_at(norm, i + 1))
            hit = F.filter(out, lambda g: (g["a"] == h["a"]) & (g["b"] == h["b"]))
            above, below = F.get(raw, i - 1), F.get(raw, i + 1)
            # between a line that isn't finished and one that goes on, it is a line of a paragraph
            inside = F.coalesce(above.rlike(_RUNS_ON) & line.rlike(_GOES_ON), F.lit(False)) | F.coalesce(below.rlike(_GOES_ON), F.lit(False))
            evidence = kind_of(F.lower(F.trim(line))).isin("script", "error", "filler") | has_placeholder(line)
            return (F.size(hit) == 0) | inside | (~F.exists(hit, lambda g: g["furniture"]) & F.coalesce(evidence, F.lit(False)))

        return let(F.filter(raw, stays), lambda kept: F.when(F.size(kept) > 0, kept).otherwise(raw))

    parts = F.struct(text_lines(text).alias("raw"), normal_lines(text).alias("norm"), gone.alias("out"))
    return F.when(gone.isNull(), text).otherwise(F.array_join(let(parts, cut), "\n"))


def kind(text: Column) -> Column:
    """'placeholder', 'filler', 'error', 'script', or null for content, of a residual text."""
    # every placeholder pattern asks for one of these signs or words
    hint = r"[\[\](){}<>$#@%_\x{AB}]|TBD|yy|TO BE|T\.B"
    verdict = lambda x: F.when(x.rlike(hint) & has_placeholder(x), F.lit("placeholder")).otherwise(_whole(sentences(F.lower(x))))
    return let(joined(text, over_blank=True), verdict)


def judge(df: DataFrame) -> DataFrame:
    """ocr_id, kind of each record: 'placeholder', 'filler', 'error', 'script', or null for content."""
    rows = df.select("ocr_id", "run_id", "text")
    both = rows.join(gone_lines(rows), F.col("ocr_id") == F.col("gid"), "left")
    whole = F.when(F.col("gone").isNotNull(), let(joined(F.col("text"), over_blank=True), lambda x: _whole(sentences(F.lower(x)))))
    return both.select("ocr_id", F.coalesce(kind(residual(F.col("text"), F.col("gone"))), whole).alias("kind"))


def _whole(parts: Column) -> Column:
    """The kind the sentences consist of: every one is evidence or goes with it, and one is evidence; one fold over them."""
    start = F.struct(F.lit(True).alias("ok"), F.lit(None).cast("string").alias("kind"))

    def step(acc: Column, s: Column) -> Column:
        k = F.when(acc["ok"], kind_of(s))
        # the kind is worked out once and taken apart by a fold over an array of it
        return F.aggregate(F.array(k), acc, lambda a, x: F.struct((a["ok"] & x.isNotNull()).alias("ok"), F.coalesce(a["kind"], F.when(x != "with", x)).alias("kind")))

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["ok"], acc["kind"]))


def found(df: DataFrame) -> DataFrame:
    return judge(df).where(F.col("kind").isNotNull()).select("ocr_id").distinct()


def content(df: DataFrame) -> DataFrame:
    """The records that are real content, unchanged, with all their columns."""
    bad = judge(df).where(F.col("kind").isNotNull()).select("ocr_id").distinct().alias("bad")
    return df.alias("all").join(bad, F.col("all.ocr_id") == F.col("bad.ocr_id"), "left_anti")
