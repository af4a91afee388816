"""Template residue, filler and error-page text.

``find_residue`` looks at a title and a content and names what a template or a
server left there.

* Unfilled placeholders are read by one small grammar for each kind of delimiter. A
  placeholder inside code, or inside a sentence that talks about templates, is a
  mention. Density decides for the text: where it mentions as many as it leaves open
  and talks about templates throughout, it is a tutorial and all of them are mentions;
  where open placeholders are a tenth of its words, it is a template whatever it says.
* Notices are no list of sentences. Each word of a sentence is looked up in a small
  lexicon of ideas (a page, a system, access, scripts; missing, failed, refused, switched
  on). A sentence is a notice if its ideas combine to one (a page that is missing, scripts
  that must be switched on) and cover it: prose that merely mentions them brings other
  words along.
* Filler is judged by the share of dummy-Latin words in a sentence, by words that are
  repeated, and by ideas of editors' dummy text.

Defined results: null and empty texts hold nothing; repeated rows are judged
alike; any other column is left alone.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

#: Opening characters, then the grammar of a whole placeholder in that delimiter.
GRAMMARS = [
    ("mustache", "{{", re.compile(r"\{\{\{?\s*[#/^&>!]?\s*[A-Za-z_][\w.\-|:'\" ]*\}\}")),
    ("block tag", "{%", re.compile(r"\{%-?\s*[A-Za-z][^%\n]*%\}")),
    ("dollar brace", "${", re.compile(r"\$\{[A-Za-z_][\w.]*\}")),
    ("hash brace", "#{", re.compile(r"#\{[A-Za-z_@][\w.]*\}")),
    ("bang brace", "{!", re.compile(r"\{!{1,2}\s*[A-Za-z_$][\w.>$-]*\s*!{0,2}\}")),
    ("embedded code", "<%", re.compile(r"<%[=#@-]?\s*[^%\n]+%>")),
    ("processing instruction", "<?", re.compile(r"<\?(?:php|=)[^\n]*?\?>")),
    ("double percent", "%%", re.compile(r"%%[A-Za-z_][\w.]*%%")),
    ("double at", "@@", re.compile(r"@@[A-Za-z_][\w.]*@@")),
    ("double underscore", "__", re.compile(r"(?<!\w)__[A-Za-z][\w.]*?__(?!\w)")),
    ("merge tag", "*|", re.compile(r"\*\|[A-Za-z_][\w.:]*\|\*")),
    ("double bracket", "[[", re.compile(r"\[\[\s*[A-Za-z_][\w. ]*\]\]")),
    ("named brace", "{", re.compile(r"(?<![{$#!\w])\{[A-Za-z]+(?:[_.][A-Za-z]+)+\}(?!\})")),
    ("instruction", "[", re.compile(r"\[(?:insert|your|add|enter|name of|image|photo|caption|headline|title|placeholder)\b[^\]\n]*\]", re.I)),
    ("instruction", "<<", re.compile(r"<<\s*(?:add|insert|enter|your|todo)\b[^>\n]*>>", re.I)),
    ("instruction", "(", re.compile(r"\((?:placeholder|dummy)\b[^)\n]*\)", re.I)),
    ("note", "TODO", re.compile(r"\bTODO\s*[:-]\s*\w+[^.\n]*")),
    ("note", "TK", re.compile(r"\bTK(?:\s+TK)+\b")),
    ("note", "XXX", re.compile(r"\bXXX\b[^\n]*?\bXXX\b")),
    ("note", "goes here", re.compile(r"\b(?:title|headline|text|name|caption|content|copy)\s+goes\s+here\b", re.I)),
]

# Words of prose about templates, in the languages of the tables.
ABOUT = re.compile(
    r"\b(?:templates?|templating|syntax|placeholders?|variables?|merge (?:fields?|tags?)|curly|braces|brackets|filled in|tutorials?|documentation|snippets?|source code|vorlagen?|platzhalter|plantillas?|gabarits?|modèles?|modelos?|modell[oi]|sjablo(?:on|nen)|szablon\w*|шаблон\w*)\b",
    re.I,
)

# The usual dummy-Latin words.
LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)

# Word stems by idea, in the languages of the tables. A word has an idea if it
# begins with a stem; a stem after a star also counts within a compound.
IDEAS = {
    "thing": "page site url address link file document resource content something inhalt contenu contenido conteúdo contenuto inhoud seite datei dokument adresse fichier ressource página sitio recurso archivo ficheiro arquivo pagina sito risorsa bestand bron stron plik zasób страниц сайт файл ресурс request angefordert demandé solicitad pedid richiest gevraagd żądan запрошенн",
    "system": "server service connection gateway proxy database datastore system session application app login internal unexpected dienst verbindung datenbank anwendung sitzung intern serveur connexion application session servidor servicio conexión aplicación sesión serviço conexão ligação aplicação sessão servizio connessione applicazione sessione verbinding toepassing sessie serwer usług połączeni aplikacj sesj wewnętrzn сервер сервис соединени приложени сесси внутренн",
    "access": "access authorized permission permissions zugriff zugang berechtigung accès acceso permiso acesso accesso toegang dostęp доступ",
    "fail": "error errors fail failed failure wrong *fehler serverfout fehlgeschlagen schiefgelaufen erreur échou échec erro falhou errore fallit fout mislukt błąd błęd ошибк сбой establish",
    "missing": "found exist exists available gefunden existiert erreichbar verfügbar trouvé existe encontrad disponib trovat esist esiste gevonden bestaat beschikbaar bereikbaar znalezion istnieje dostępn найден существует",
    "gone": "moved deleted removed gone unavailable expired timeout timed verschoben gelöscht entfernt abgelaufen introuvable déplacé supprimé indisponible expiré movid eliminad expirad indisponib indisponív spostat rimoss scadut verplaatst verwijderd verlopen przeniesion usunięt niedostępn wygasł перемещ удален удалён недоступ истек",
    "refuse": "denied forbidden blocked unauthorized restricted refused invalid bad verweigert gesperrt verboten blockiert refusé interdit bloqué denegad prohibid bloquead negad proibid negat vietat bloccat geweigerd geblokkeerd odmow zabronion zablokowan запрещ заблокир отказано",
    "script": "javascript script *script *skript js скрипт skrypt noscript",
    "cookie": "cookie cookies",
    "switch": "enable enabled disabled turn turned switch switched activate activated allow allowed require required requires must need needs support aktivier deaktivier eingeschaltet einschalten erforderlich benötigt müssen muss active activer activez désactiv autoris exige nécessite doit devez activ habilit requier necesita debe permitid ative ativar ativ precisa permitidos attiv abilit disabilit richiede devono schakel inschakelen zet moeten vereist nodig włącz wymaga należy включ разреш требу долж необходим",
    "check": "checking check verify verifying confirm überprüf geprüft prüfen vérifi comprob verific controll gecontroleerd sprawdz weryfik проверк проверя подтверд",
    "agent": "browser human robot captcha navigateur navegador przegląd браузер mensch humain humano umano człowiek человек",
    "text": "text texte texto testo tekst текст paragraph absatz paragraphe párrafo parágrafo paragrafo alinea akapit абзац words post article title heading headline caption copy content",
    "sample": "sample demo dummy example placeholder beispiel mustertext exemple ejemplo exemplo esempio voorbeeld przykład пример",
    "edit": "replace edit delete insert write type ersetz bearbeit einfüg remplac modifi insér reemplac edit substitu escrev sostitu scriv vervang bewerk zastąp wpisz замен встав",
    "here": "here hier ici aquí aqui qui tutaj здесь",
    "mine": "your ihr ihren dein votre su tu seu vosso tuo suo vostro uw jouw twój ваш",
    "no": "not no cannot can doesn t nicht kein keine ne n pas não non niet geen nie не нет",
}
# Other words of such sentences, beside those of up to three letters.
ASIDE = frozenset(
    "please sorry again later data store side went view быть работы vedere work works properly without wird werden konnte kann occurred encountered establishing soient steht staan this that your from with have been will were oops http plus para você nous oder vous auch nach maar door voor naar aan staan para este esta está были была было через please while before temporarily momentarily currently reload refresh continue proceed resource could seems looking trying reach requested logged secure whether bitte später erneut versuchen vorübergehend wurde wurden diese dieser dieses ihrem ihren ihrer nicht fortzufahren anzuzeigen veuillez réessayer momentanément cette votre notre dans soient pour afficher continuer favor temporalmente inténtelo tarde nuevo nuestro continuar temporariamente tente novamente mais questa questo temporaneamente riprova tardi visualizzare continuare deze tijdelijk probeer later opnieuw bekijken proszę chwilowo spróbuj ponownie później została został twojej swojej zobaczyć пожалуйста временно повторите попытку позже чтобы вашем своем этой этот этого увидеть these their there those would should which where about having doing going".split()
)
#: Ideas that make a notice together; ``gone`` needs no negation, ``missing`` does.
_BITS = {idea: 1 << n for n, idea in enumerate([*IDEAS, "code"])}
_RULES = tuple(
    sum(_BITS[i] for i in rule.split())
    for rule in "thing missing no|thing gone|thing fail|thing refuse|system missing no|system gone|system fail|system refuse|access refuse|access no missing|access no thing|script switch|cookie switch agent|check agent|check system|code missing no|code gone|code fail|code refuse|code access|fail system|sample text|edit text mine|edit text sample|text here mine".split("|")
)
_DUMMY = _BITS["text"]
_CODE = re.compile(r"(?:^|[^\w.,])[45]\d\d(?:$|[^\w.,])")
_CODED = re.compile(r"^\W*(?:(?:http|error|fehler|erreur|errore|erro|fout|błąd|ошибка)\W+(?:[\d.]+\W+)?)*[45]\d\d\b")
#: One word in so many may lie outside the ideas of a notice, and of editors' dummy text.
OUTSIDE, OUTSIDE_DUMMY = 8, 4

# What programs print in place of a text, as a whole line.
LINES = frozenset(["undefined", "nan", "null", "null null", "[object object]", "noscript", "loading…", "loading...", "just a moment", "just a moment...", "just a moment…"])
# The titles publishing systems give new pages.
TITLES = LINES | frozenset(["lorem ipsum", "sample page", "draft copy", "hello world", "new page", "untitled"])
_PROGRAM = re.compile(r"^(?:fatal error|traceback|warning|uncaught \w+|exception)\s*[:(].*$|^warning: \w+\([^)]*\).*$", re.I)
_PROGRAM_KEYS = ("fatal error", "traceback", "warning", "uncaught ", "exception")
_REPEAT = re.compile(r"^\W*(\w{2,})(?:\W+\1){3,}\W*$", re.I)
#: Dummy Latin holds one of these.
_LONGER = frozenset(w for w in LATIN if len(w) >= 4)
#: Kinds of residue, as bits.
PLACE, PROGRAM, REPEATS, NOTICE, FILLER = 1, 2, 4, 8, 16
ALL = 31
_SENTENCE = re.compile(r"(?<=[.!?…])\s+")
_WORD = re.compile(r"[^\W\d_]+")
_OPENERS = tuple(dict.fromkeys(o for _, o, _ in GRAMMARS if o not in ("(", "[", "{")))


class Lexicon:
    """Which ideas a text or a word holds, as bits. The search tree is built where it is used."""

    def __init__(self, ideas: dict[str, str]):
        self.stems: dict[str, int] = {}
        self.inner: list[str] = []
        for idea, stems in ideas.items():
            for stem in stems.split():
                if stem[0] == "*":
                    stem = stem[1:]
                    self.inner.append(stem)
                self.stems[stem] = self.stems.get(stem, 0) | _BITS[idea]
        self.tree = None
        self.known: dict[str, int] = {}

    def __getstate__(self) -> dict:
        return {"stems": self.stems, "inner": self.inner, "tree": None, "known": {}}

    def within(self, low: str) -> int:
        """The ideas whose stems stand anywhere in a text: a superset of its words' ideas."""
        if self.tree is None:
            try:
                import ahocorasick

                self.tree = ahocorasick.Automaton()
                for stem, bits in self.stems.items():
                    self.tree.add_word(stem, bits)
                self.tree.make_automaton()
            except ImportError:
                self.tree = ()
        out = 0
        if self.tree == ():
            for stem, bits in self.stems.items():
                if stem in low:
                    out |= bits
            return out
        for _, bits in self.tree.iter(low):
            out |= bits
        return out

    def of(self, word: str) -> int:
        """The ideas of a word."""
        found = self.known.get(word)
        if found is None:
            found = self.stems.get(word, 0)
            for stem, bits in self.stems.items():
                if len(stem) >= 4 and word.startswith(stem):
                    found |= bits
            for stem in self.inner:
                if stem in word:
                    found |= self.stems[stem]
            if len(self.known) < 100_000:
                self.known[word] = found
        return found


_LEXICON = Lexicon(IDEAS)


def _combines(bits: int) -> bool:
    return any(bits & rule == rule for rule in _RULES)


def _filler(sentence: str) -> bool:
    words = _WORD.findall(sentence.lower())
    known = [w for w in words if w in LATIN]
    return len(words) >= 4 and len(known) >= 0.6 * len(words) and not _LONGER.isdisjoint(known)


def _notice(sentence: str) -> str | None:
    """What a sentence says if its ideas combine and cover it: ``notice``, or ``filler``
    for editors' dummy text."""
    low = sentence.lower()
    coded = _BITS["code"] if _CODED.match(low) else 0
    if not _combines(_LEXICON.within(low) | coded):
        return None
    words = _WORD.findall(low)
    if not words or len(words) > 24:
        return None
    own = [_LEXICON.of(w) for w in words]
    bits = coded
    for b in own:
        bits |= b
    if not _combines(bits):
        return None
    dummy = not any(bits & rule == rule and not rule & _DUMMY for rule in _RULES)
    if sum(not b and len(w) > 3 and w not in ASIDE for w, b in zip(words, own)) > len(words) // (OUTSIDE_DUMMY if dummy else OUTSIDE):
        return None
    # Small words alone carry no notice: at least a quarter of the words have ideas.
    if 4 * (sum(bool(b) for b in own) + bool(coded)) < len(words):
        return None
    return None if not dummy and ABOUT.search(sentence) else "filler" if dummy else "notice"


def residue_line(line: str, may: int = ALL) -> str | None:
    """What kind of residue a whole line is, or holds as a whole sentence; ``may`` are the
    kinds that ``may_hold`` leaves possible."""
    low = line.strip().lower()
    if may & PROGRAM and (low in LINES or _PROGRAM.match(low)):
        return "program output"
    if may & REPEATS and _REPEAT.match(low):
        return "filler"
    notice, filler = may & NOTICE and _may_notice(low), may & FILLER and _may_fill(low)
    if notice or filler:
        for sentence in _SENTENCE.split(line.strip()):
            if notice and (kind := _notice(sentence)):
                return kind
            if filler and _filler(sentence):
                return "filler"
    return None


def _placeholders(text: str) -> tuple[list[tuple[str, str]], int]:
    """(kind, placeholder) of each unfilled one, and the number of mentions."""
    found, mentioned, fenced = [], 0, False
    for line in text.split("\n"):
        if line.lstrip().startswith("```"):
            fenced = not fenced
            continue
        for kind, opener, grammar in GRAMMARS:
            if opener not in line and opener != "goes here":
                continue
            for m in grammar.finditer(line):
                before, after = line[: m.start()], line[m.end() :]
                sentence = re.split(r"[.!?]\s", before)[-1] + re.split(r"[.!?](?:\s|$)", after)[0]
                code = fenced or before.count("`") % 2 == 1 or ("<code>" in before and "</code>" in after)
                prose = len(_WORD.findall(sentence)) >= 4 and ABOUT.search(sentence)
                if code or prose:
                    mentioned += 1
                else:
                    found.append((kind, m.group()))
    return found, mentioned


def open_placeholders(text: str) -> list[tuple[str, str]]:
    """(kind, placeholder) of the unfilled ones, none where the text is a tutorial: it
    mentions as many as it leaves open, and every fourth of its sentences is about templates."""
    found, mentioned = _placeholders(text)
    if not found or mentioned < len(found):
        return found
    if 10 * len(found) >= len(_WORD.findall(text)):
        return found
    sentences = [s for line in text.split("\n") for s in _SENTENCE.split(line) if s.strip()]
    about = sum(bool(ABOUT.search(s)) for s in sentences)
    return [] if 4 * about >= len(sentences) else found


def _may_place(text: str, low: str) -> bool:
    return any(o in text for o in _OPENERS) or "[" in text or "{" in text or "(placeholder" in low or "(dummy" in low or "goes here" in low


def _may_fill(low: str) -> bool:
    """Whether two dummy-Latin words stand next to each other or but for one word;
    where they are 0.6 of four words or more, some do."""
    words = _WORD.findall(low)
    if _LONGER.isdisjoint(words):
        return False
    known = [w in LATIN for w in words]
    return any(x and (y or z) for x, y, z in zip(known, known[1:], [*known[2:], False]))


def _may_notice(low: str) -> bool:
    return _combines(_LEXICON.within(low) | (_BITS["code"] if _CODE.search(low) else 0))


def may_hold(text: str) -> int:
    """The kinds of residue a text may hold, a cheap screen: a kind it leaves out stands
    in no line of the text."""
    low = text.lower()
    lines = low.split("\n")
    kinds = (_may_place(text, low), any(k in low for k in _PROGRAM_KEYS) or any(x.strip() in LINES for x in lines), any(_REPEAT.match(x) for x in lines), _may_notice(low), _may_fill(low))
    return sum(bit for bit, holds in zip((PLACE, PROGRAM, REPEATS, NOTICE, FILLER), kinds) if holds)


def line_holds(line: str, may: int = ALL) -> bool:
    """Whether a line is residue or consists of one unfilled placeholder."""
    if residue_line(line, may):
        return True
    return bool(may & PLACE) and any((o in line or o == "goes here") and (m := g.search(line)) and len(m.group()) >= 0.6 * len(line.strip()) for _, o, g in GRAMMARS)


def find_residue(text: str | None, title: bool = False) -> list[tuple[str, str]]:
    """(kind, evidence) of everything a template or server left in a text."""
    if not text:
        return []
    out: list[tuple[str, str]] = []
    may = may_hold(text)
    if may & PLACE:
        out += open_placeholders(text)
    if title and re.sub(r"\s*\(\d+\)$", "", text.lower().strip()) in TITLES:
        out.append(("title", text))
    if may & ~PLACE:
        for line in text.split("\n"):
            if line.strip() and (kind := residue_line(line, may)):
                out.append((kind, line.strip()))
    return out


def detect(items: DataFrame, key: str = "id", title: str = "title", content: str = "content") -> DataFrame:
    """(key, place, kind, evidence): one row for each residue found.

    A map over rows without a shuffle; whole texts are read.
    """
    kind_of_key = items.schema[key].dataType

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for i, t, c in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                hits = [("title", *x) for x in find_residue(t, True)] + [("content", *x) for x in find_residue(c)]
                rows += [(i.as_py(), *h) for h in hits]
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field(0).type), *(pa.array(x, pa.string()) for x in cols[1:])], names=[key, "place", "kind", "evidence"])

    return items.select(key, title, content).mapInArrow(run, f"{key} {kind_of_key.simpleString()}, place STRING, kind STRING, evidence STRING")


def without_residue(items: DataFrame, key: str = "id") -> DataFrame:
    """The rows that hold no residue, unchanged."""
    return items.join(detect(items, key).select(key).distinct(), key, "left_anti")
