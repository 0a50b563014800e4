"""Labelled exemplars of template residue and of speech that resembles it, written from public knowledge: the reason phrases
of HTTP, messages of common servers, browsers, shells and languages, prompts of common editors, and their usual translations.

Fixed values. An exemplar is a clause and not a whole message: a message is explained by all clauses it holds together, and by
the helping words of its class, which explain but are never looked for. In a clause ``{}`` stands for a placeholder, ``404`` for a status
code and ``0a1b2c3d`` for a request number. Alternatives are written out by rule from their parts, separated by ``|``.
"""

from __future__ import annotations

import sys
from itertools import product

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _each(*parts: str) -> list[str]:
    """All sentences from parts whose alternatives are separated by ``|``."""
    return [" ".join(x for x in p if x) for p in product(*[p.split("|") for p in parts])]


# --- prompts to fill a slot, as they stand in brackets

_THINGS = "name|speaker name|character name|text|title|subtitle|caption|dialogue|dialog|line|translation|description|date|episode|company|email|address|image|link|song|lyrics|quote"
SLOT = [
    *_each("insert|enter|add|type|put|write", _THINGS), *_each("your", _THINGS), *_each(_THINGS, "goes here|tbd|todo|missing"), *_each("todo|tbd", _THINGS),
    # the same in other languages: a verb, a thing and a place
    *_each("insertar|inserta|inserte|introducir|introduzca|escribe|escriba|añadir", "texto|nombre|título|diálogo|subtítulo|traducción", "aquí|"),
    *_each("inserir|insira|escreva|digite", "texto|nome|título|diálogo|legenda|tradução", "aqui|"), *_each("inserire|inserisci|scrivi", "testo|nome|titolo|dialogo|sottotitolo|traduzione", "qui|"),
    *_each("insérer|insérez|saisir|saisissez|entrez", "le texte|texte|le nom|nom|le titre|titre|dialogue|traduction", "ici|"), *_each("texte|nom|titre|dialogue", "à", "insérer|compléter|définir"), *_each("hier", "text|name|titel|dialog|untertitel|übersetzung", "einfügen|eingeben|eintragen"),
    *_each("tekst|naam|titel|dialoog|ondertitel|vertaling", "hier", "invoegen|invullen|invoeren"), *_each("вставьте|вставить|введите|ввести", "текст|имя|название|реплику|перевод", "здесь|сюда|"),
    *_each("nombre", "del|de", "personaje|hablante"), *_each("nome", "do|da|del", "personagem|personaggio"), *_each("nom", "du|de", "personnage|locuteur"), *_each("name", "der|des", "figur|sprechers"), *_each("naam", "van|", "personage|spreker"), *_each("имя", "персонажа|героя|говорящего"),
    *["".join(x) for x in product(["ここに", ""], ["テキスト", "名前", "字幕", "セリフ", "タイトル", "登場人物名", "キャラクター名", "話者名", "翻訳"], ["を入力", "を挿入", "を記入"])], "登場人物名", "キャラクター名", "話者名",
]

# --- filler

FILLER = [
    *_each("sample|dummy|test|example|placeholder|filler|mock", "text|subtitle|subtitles|caption|captions|title|line|content|dialogue|copy"), *_each("this is", "dummy|sample|placeholder|filler|example|test", "text|subtitle|caption"),
    *_each("type|enter|write|put|add", "your", "text|caption|subtitle|title|dialogue", "here|in this box|below"), *_each("your", "text|subtitle text|caption|subtitle|title|dialogue|content", "goes here|here"), *_each("text|content|caption|subtitle|title", "goes here"),
    *_each("todo|tbd|fixme", "write|add|translate|fix|check|insert", "subtitles|subtitle|captions|caption|text|translation|dialogue|line"), *_each("subtitle|caption|title|text", "line|number"), *_each("example|sample", "subtitle|caption", "replace before", "release|publishing|use"), *_each("click|tap", "to edit|here to edit", "|this|text|caption|title|subtitle"), "replace this text", "delete this line before publishing",
    *[" ".join([w] * 3) for w in "test|sample|dummy|text|line|subtitle|caption|title|placeholder|asdf|qwerty|xxxx|blah|foo|lorem".split("|")], "asdf", "asdf asdf", "asdf qwerty", "qwerty", "qwerty qwerty", "foo bar baz", "testing test test",
    *_each("texto", "de", "ejemplo|exemplo|prueba|relleno|muestra"), *_each("texte", "factice|d'exemple|de test|provisoire"), "faux texte", *_each("testo", "di", "esempio|prova|riempimento"), "testo segnaposto", "blindtext", "beispieltext", "platzhaltertext", "mustertext", "voorbeeldtekst", "plaatshoudertekst", "proeftekst",
    "пример текста", "образец текста", "текст заглушка", "текст заполнитель", "тестовый текст", *["".join(x) for x in product(["サンプル", "ダミー", "テスト", "仮の"], ["テキスト", "字幕", "文章"])],
]

#: The words of the usual filler passage that are words of no living language. The passage is shuffled and repeated in use, so
#: each of them counts as often as a term can.
LATIN = [" ".join(3 * [
    "lorem ipsum dolor amet consectetur adipiscing elit eiusmod tempor incididunt labore dolore magna aliqua",
    "enim minim veniam nostrud exercitation ullamco laboris aliquip commodo consequat",
    "duis aute irure reprehenderit voluptate velit cillum fugiat nulla pariatur",
    "excepteur occaecat cupidatat proident culpa officia deserunt mollit anim laborum",
])]

VALUE = ["undefined", "undefined undefined", "null null", "null null null", "nan nan", "none none", "none none none", "object object", *_each("missing", "translation|string|key|value|localization"), *_each("translation|string|key|localization", "missing|not found|is missing"), "missing string 404"]

# --- error messages

# Reason phrases of HTTP, and further ones of common servers and proxies.
_REASONS = ("bad request|unauthorized|payment required|forbidden|not found|method not allowed|not acceptable|proxy authentication required|request timeout|conflict|gone|length required|precondition failed|payload too large|content too large|request entity too large|uri too long"
            "|unsupported media type|range not satisfiable|expectation failed|misdirected request|unprocessable content|unprocessable entity|locked|failed dependency|too early|upgrade required|precondition required|too many requests|request header fields too large|unavailable for legal reasons"
            "|internal server error|not implemented|bad gateway|service unavailable|gateway timeout|gateway time-out|http version not supported|variant also negotiates|insufficient storage|loop detected|not extended|network authentication required|not available|service temporarily unavailable|backend fetch failed|access denied")
_TARGET = "page|file|document|resource|address|link|url|content|item|site|episode|video|object"
_RUNTIME = [
    "traceback most recent call last", *_each("uncaught|unhandled|fatal", "exception|error"), "exception in thread main", *_each("java lang", "nullpointerexception|illegalstateexception|outofmemoryerror|runtimeexception|stackoverflowerror"), *_each("null", "pointer|reference", "exception|"), "typeerror cannot read properties of undefined", "typeerror cannot read property of undefined",
    *_each("typeerror|referenceerror|valueerror|keyerror|nameerror|attributeerror|syntaxerror|indexerror|ioerror|oserror|runtimeerror|filenotfounderror", "undefined|is not defined|is not a function|invalid|unexpected token|no such file or directory|object has no attribute"), *_each("undefined", "variable|index|property|method|function|offset|constant"), *_each("index|list index|string index|array index", "out of", "range|bounds"),
    "segmentation fault core dumped", "bus error core dumped", "kernel panic not syncing", "stack overflow", "out of memory", "memory exhausted", "division by zero", "assertion failed", "syntax error unexpected", "parse error unexpected", "maximum execution time exceeded", "cannot redeclare", "command not found", "no such file or directory", "permission denied", "disk quota exceeded", "no space left on device", "read only file system",
    *_each("cannot|could not|unable to|failed to", "open|read|write|load|parse|decode", "file|srt|stream|template|for reading|for writing"), "failed to open stream", "broken pipe", *_each("connection", "reset by peer|refused|timed out|aborted|closed unexpectedly"), "network is unreachable", "no route to host", "name or service not known", "temporary failure in name resolution", "ssl handshake failed", "certificate has expired",
    "error establishing a database connection", *_each("could not|cannot|unable to|failed to", "connect to", "database|server|the server|host|mysql|the database|the host"), "too many connections", "you have an error in your sql syntax", "deadlock found", "upstream timed out", "upstream prematurely closed connection", "backend fetch failed guru meditation", "stack trace", "line of code",
]
_DOWN = "timed out|refused the connection|refused to connect|took too long to respond|did not answer|did not respond|is not responding|is overloaded|is unreachable|sent an empty reply|sent an empty response|sent an invalid response|is down|encountered an internal error"
ERROR = [
    *_each("404", _REASONS), "error 404", "http error 404", "http 404", *_each("status|status code|error code|code", "404"), "internal server error", "service temporarily unavailable", "service unavailable", "page not found", "file not found", "bad gateway", "gateway timeout", "gateway time-out", "too many requests",
    *_RUNTIME,
    *_each("", _TARGET, "you requested|you asked for|you opened|you followed|you are looking for|you were looking for|you tried to reach"),
    *_each("requested", _TARGET, "was not found|could not be found|does not exist|is not available"), *_each(_TARGET, "could not be found|cannot be found|does not exist|no longer exists|is no longer available|has expired|was removed by its uploader"), *_each("we couldn't find|we could not find|we can't find|cannot find", "", _TARGET),
    *_each("server|service|host|node|remote end|remote host|upstream|gateway|website", _DOWN), *_each("server|service|website|site|page", "is temporarily unavailable|is currently unavailable|is under maintenance|is down for maintenance"), "site under maintenance", "scheduled maintenance", "down for maintenance", "back online shortly",
    *_each("you do not have|you don't have|insufficient|missing", "permission|permissions", "to access|to view|to open"), *_each("this content|this video|this item|this file|this page", "is blocked|is not available|is unavailable", "in your region|in your country"), *_each("your account", "may not|cannot|is not allowed to", "open|access|view", "this item|this file|this page"),
    *_each("your session", "has expired|expired|has timed out", "log in again|sign in again|please log in"), *_each("download|upload", "limit reached|limit exceeded|quota exceeded|failed|could not be started"), *_each("rate limit|bandwidth limit|request limit", "exceeded|reached"), *_each("something went wrong", "|on our side|on our end|please try again|try again later"), *_each("an|an unexpected|an unknown", "error", "occurred|has occurred"),
    *_each("access denied|accessdenied|nosuchkey|nosuchfile|nosuchbucket|internalerror|requesttimeout", "0a1b2c3d"), "the specified key does not exist", *_each("request|reference|ref|incident|error|ray|trace", "id|no|number", "0a1b2c3d"), *_each("unable to connect|can't be reached|cannot be reached|secure connection failed|server not found|your connection is not private|dns probe finished nxdomain"),
    # the same in other languages
    *_each("página|pagina|archivo|fichero|recurso", "no encontrada|no encontrado"), *_each("acceso denegado|acceso no autorizado", "0a1b2c3d"), *_each("error 404", "servicio no disponible|página no encontrada|acceso denegado|error del servidor"), "servicio no disponible", "error interno del servidor",
    *_each("página|arquivo|recurso", "não encontrada|não encontrado"), "acesso negado 0a1b2c3d", *_each("erro 404", "serviço indisponível|página não encontrada|acesso negado|no servidor"), "serviço indisponível", "erro interno do servidor",
    *_each("page|fichier|ressource", "introuvable|non trouvée"), "accès refusé 0a1b2c3d", *_each("erreur 404", "service indisponible|page introuvable|accès refusé|du serveur"), "service indisponible", "temporairement indisponible", "erreur interne du serveur",
    *_each("seite|datei|dokument", "nicht gefunden"), "zugriff verweigert 0a1b2c3d", *_each("fehler 404", "dienst nicht verfügbar|seite nicht gefunden|zugriff verweigert|server nicht erreichbar"), "dienst nicht verfügbar", "interner serverfehler", "server nicht erreichbar",
    *_each("pagina|file|risorsa", "non trovata|non trovato"), "accesso negato 0a1b2c3d", *_each("errore 404", "servizio non disponibile|pagina non trovata|accesso negato|del server"), "servizio non disponibile", "errore interno del server",
    *_each("pagina|bestand", "niet gevonden"), "toegang geweigerd 0a1b2c3d", *_each("fout 404", "dienst niet beschikbaar|pagina niet gevonden|toegang geweigerd|server niet bereikbaar"), "dienst niet beschikbaar", "interne serverfout", "server niet bereikbaar",
    *_each("страница|файл", "не найдена|не найден"), *_each("доступ", "запрещён|запрещен", "0a1b2c3d"), *_each("ошибка 404", "сервис недоступен|страница не найдена|доступ запрещён|сервера"), "сервис недоступен", "внутренняя ошибка сервера",
    *["".join(x) for x in product(["ページ", "ファイル"], ["が見つかりません", "は見つかりませんでした"])], "アクセスが拒否されました 0a1b2c3d", *_each("エラー 404", "サーバーに接続できません|ページが見つかりません|アクセスが拒否されました|サービスは利用できません"), "サーバーに接続できません", "内部サーバーエラー",
]

# --- notices that scripts are required

_SCRIPT = "javascript|js|scripts|scripting|script execution|cookies"
NOTICE = [
    *_each("enable|activate|allow|permit|turn on|switch on|requires|require|needs|need|without|uses", _SCRIPT), *_each("javascript|js|scripts|scripting|script execution", "is disabled|is off|is turned off|is switched off|is not enabled|is not available|is blocked|are blocked|are disabled|must be on|is required|are required"),
    *_each("browser", "does not support|is not supported|has disabled|runs", "javascript|scripts|enable scripts"), "verify that you are human scripts", "verify you are human", "checking your browser before accessing", "checking your browser before opening", "please enable cookies", "enable javascript to run this app", "noscript",
    *_each("activa|active|activar|habilita|habilite|habilitar", "javascript"), *_each("ative|ativar|habilite|habilitar|ligue", "o javascript"), *_each("activez|activer", "javascript"), "javascript aktivieren", "aktivieren javascript", *_each("schalte|schalten", "javascript ein"), "javascript einschalten", *_each("attiva|attivare|abilita|abilitare", "javascript"),
    *_each("zet|schakel", "javascript", "aan|in"), "javascript inschakelen", *_each("включите|включить|разрешите", "javascript"), *_each("javascript", "を有効にしてください|を有効にする必要があります|が無効です|が必要です"),
]

# --- helping words of classes

_PLAIN = "the this that a an in on of to for at by is are was has been be and or not it its with no"
HELP = {
    "error": _PLAIN + " please sorry we cue cues caption captions subtitle subtitles oops whoops error errors warning fatal panic code status message request requested http https html title ref reference réf rif nr núm código код номер number id pid line file page our your try again later in seconds minutes soon back contact support administrator webmaster help reload refresh moved deleted removed gone check spelling address"
    " directory resource render traceback undefined variable host port server cannot could exist exists temporarily available unavailable longer",
    "notice": _PLAIN + " please kindly our you your must need have want continue we noticed that seems looks like so go nothing can cannot could shown show display view see use load loading reading read open run running work works will does page site player viewer reader app file captions caption subtitles subtitle content browser browsers settings extension reload reloaded allow enable them then newer one get another human stays empty"
    " en su tu navegador no seu dans votre navigateur in ihrem nel tuo je в браузере para ver los subtítulos as o las legendas página pour afficher voir les sous titres la page bitte um die untertitel zu sehen anzeigen per vedere i sottotitoli om de ondertitels te zien чтобы увидеть субтитры страницу пожалуйста "
    + " ".join("".join(x) for x in product(["字幕", "このページ", "ページ", "コンテンツ", "動画", "ファイル"], ["を表示するには", "を見るには", "を閲覧するには"])),
    "latin": "sit ut et sed ad ex ea in esse non sunt qui id est quis eu do dolor",
    "slot": "here the a an your in",
    "filler": "this is the a for in your cue number no here box replace before release",
    "speech": _PLAIN + " we you they i he she when if then now name page value and this",
    "value": "in en cues cue line string key",
}

#: Speech about such things: lessons and talk of templates, where a placeholder is what is spoken of.
SPEECH = [
    *_each("in this|in our|the next|in the next", "lesson|example|chapter|tutorial|course|exercise"), *_each("gets|is|will be|was", "replaced|substituted|filled in|rendered|expanded"), *_each("render|replace|substitute|expand|parse", "the|this", "page|template|variable|placeholder"),
    *_each("the", "placeholder|variable|template|macro", "stands for|becomes|fills it in|replaces it"), *_each("double|curly|square|angle", "braces|brackets"),
]

#: Words of somebody who speaks or is spoken of, which messages of machines don't have.
SPOKEN = "i me my mine myself he him his she her hers said says asked asks told replied cried whispered answered yo mi él ella dijo dice eu meu ele ela disse je mon ma il elle dit ich mein er sie sagte sagt io mio lui lei disse dice detto ik mijn hij zij zei zegt я мне мой он она сказал сказала"

#: class -> its phrases and the least containment of one of them in a window.
CLASSES = {"placeholder": (["{}"], 0.9), "slot": (SLOT, 0.75), "filler": (FILLER, 0.75), "latin": (LATIN, 0.01), "value": (VALUE, 0.75), "error": (ERROR, 0.8), "notice": (NOTICE, 0.75)}
