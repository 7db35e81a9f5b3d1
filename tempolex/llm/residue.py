"""Template residue, filler, error pages and script notices: a multi-pattern automaton over normalised text.

One automaton holds whole phrases in several languages, which are findings in themselves, and the openings of slots and
status lines. Every finding begins with a hit of the automaton: where an opening stands, the form it opens is tried at
that place and nowhere else. Words of dummy Latin count only where several stand close together. A document comes out with
any finding; it is marked for exclusion when the findings cover much of it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tempolex.llm.arrow import plain, small_batches

# What a script notice speaks of, what it asks for and what it states; each two are joined into phrases.
SCRIPT_SUBJECTS = ["javascript", "java script", "scripts", "scripting", "cookies"]
SCRIPT_ASKED = ["enable", "activate", "allow", "turn on", "switch on", "enable your browser's"]
SCRIPT_STATED = ["must be enabled", "must be turned on", "must be switched on", "must be allowed", "needs to be enabled", "need to be enabled", "has to be enabled", "have to be enabled", "should be enabled",
                 "to be enabled", "to be switched on", "to be turned on", "is disabled", "are disabled", "is not enabled", "are not enabled", "is turned off", "are turned off", "is switched off", "are switched off",
                 "is blocked", "are blocked", "is off", "are off", "is not supported", "disabled in your browser"]

# Phrases of error pages, script and cookie notices and filler.
SCRIPT = """
enable javascript|enable java script|enabling javascript|allow javascript|activate javascript|turn on javascript|switch on javascript
javascript is disabled|javascript is not enabled|javascript is turned off|javascript must be enabled|javascript is required
javascript seems to be disabled|javascript appears to be disabled|requires javascript|need javascript|needs javascript|without javascript
enable cookies|enable cookie|allow cookies|cookies are disabled|cookies must be enabled|cookies are required|accept cookies to continue
requires cookies|cookies and js|scripts must be on|scripts must be enabled|scripts must be allowed|scripts to be switched on|scripts to be enabled
scripts are disabled|scripts are blocked|does not run scripts|does not support scripts|does not support javascript|scripting is off
scripting is disabled|<noscript>|</noscript>|enable scripts|allow scripts|javascript to be enabled|javascript and cookies
activez javascript|activer javascript|veuillez activer|javascript est desactive|activez les cookies|aktivieren sie javascript
javascript aktivieren|javascript ist deaktiviert|cookies aktivieren|habilite javascript|active javascript|habilitar javascript|activar javascript
javascript esta desactivado|abilita javascript|attivare javascript|ative o javascript|включите javascript|javascript отключен
جاوا اسکرپٹ فعال|جاوا اسکرپٹ کو فعال|جاوا سکرپٹ فعال|جاوا اسکرپٹ بند|جاوا اسکرپٹ چالو|کوکیز فعال|کوکیز کی اجازت|تفعيل جافا سكريبت|يرجى تفعيل
"""

ERROR = """
page you asked for does not exist|page you requested|page you are looking for|page cannot be found|page could not be found|page can't be found
can't find that page|cannot find that page|couldn't find that page|page not found|file not found on this server|requested url was not found
check the address or go back|go back to the home page|return to the home page|server could not return the requested|server error in
could not connect to the database|error establishing a database connection|connection timed out|connection refused|connection was reset
connection reset by peer|took too long to respond|site can't be reached|unable to connect to the server|upstream returned|upstream sent
upstream timed out|access denied.|access denied!|you do not have permission to|you don't have permission to
not authorized to view|not authorised to view|session has expired|session expired.|session timed out|sign in again|log in again
please log in to continue|please sign in to continue|something went wrong while|something went wrong.|something went wrong,|oops!
an unexpected error|an unknown error occurred|an error occurred while|an error has occurred|internal server error occurred
too many requests from|slow down and retry|you have been rate limited|checking your browser before|checking if the site connection is secure
verify you are human|complete the captcha|service is down for maintenance|down for maintenance
please come back later|please try again later|document could not be displayed|page could not be displayed|page cannot be displayed|file type is not supported
download failed|failed to open stream|the section cannot be drawn
not supported by the viewer|fatal error:|parse error:|call to undefined function|call to undefined method|uncaught exception|unhandled exception
uncaught typeerror|uncaught referenceerror|traceback (most recent call last)|stack trace:|nullpointerexception|segmentation fault|core dumped
keyerror:|valueerror:|typeerror:|nameerror:|attributeerror:|indexerror:|modulenotfounderror:|syntaxerror:|importerror:|runtimeerror:|zerodivisionerror:|filenotfounderror:|exception in thread
undefined index:|undefined variable|undefined is not a function|cannot read property|cannot read properties|notice: undefined|warning: mysql
ora-00|sqlstate[|syntax error near|you have an error in your sql|this may take a few seconds|reference id:|incident id:|ray id:|request id:
page introuvable|page non trouvee|acces refuse|acces interdit|erreur interne du serveur|une erreur est survenue|session a expire
seite nicht gefunden|seite wurde nicht gefunden|zugriff verweigert|interner serverfehler|ein fehler ist aufgetreten
pagina no encontrada|acceso denegado|error interno del servidor|ha ocurrido un error|pagina non trovata|accesso negato|страница не найдена|доступ запрещен
صفحہ نہیں ملا|صفحہ موجود نہیں|مطلوبہ صفحہ|پتہ دوبارہ دیکھیں|رسائی ممنوع|رسائی سے انکار|اجازت نہیں ہے کہ آپ|سرور میں خرابی|سرور کی خرابی|کچھ غلط ہو گیا|دوبارہ کوشش کریں|الصفحة غير موجودة|تم رفض الوصول
"""

FILLER = """
lorem ipsum|your content goes here|your text goes here|your text here|content goes here|text goes here|add your text|add text here|insert text here
type your text|sample sentence for layout|sample text for|for layout purposes|replace before publication|replace this text|holds the place of the real
placeholder sits where|placeholder text|this is a placeholder|is a placeholder for|dummy text|filler text|body copy body copy|text text text|blah blah|test test test
asdf asdf|asdfasdf|qwer qwer|qwerty qwerty|zxcv zxcv|foo bar baz|the quick brown fox jumps|quick placeholder|coming soon.|content coming soon
nothing to see here|texte a remplacer|texte ici|votre texte ici|platzhaltertext|blindtext|hier steht ihr text|texto de relleno|su texto aqui|texto aqui|testo segnaposto
یہاں متن درج|متن درج کریں|یہاں لکھیں|یہاں اپنا متن|نمونہ متن|هذا النص هو مثال|نص تجريبي
"""

#: Words of the dummy Latin text, by their unchanging beginnings.
LATIN = "lorem ipsum dolor amet consec adip elit eiusmo tempor incid labor dolore magna aliq veniam nostru exerci ullam commod conseq irure repreh volup velit cillum fugia excepte sint occae cupida proid culpa offic deser mollit laborum".split()

#: Reasons of HTTP status lines.
REASONS = "bad request|unauthorized|unauthorised|payment required|forbidden|not found|method not allowed|not acceptable|request timeout|request time-out|conflict|gone|too many requests|unavailable for legal reasons|internal server error|not implemented|bad gateway|service unavailable|gateway timeout|gateway time-out".split("|")

_STATUS = regex.compile(r"(?<![\w.,/])(?:(?:http(?:/\d(?:\.\d)?)?|error|status|code|http error|http status|error code)[ :#-]{0,3})?(?:4[0-5]\d|50\d|51[01])[ :.,\-–—]{1,4}$")

# Names of elements of web pages, which are no slots.
ELEMENTS = "p br b i u a s q em hr li ol ul td th tr div pre sub sup span body html head meta link code font form label input small strong table tbody thead script noscript style center strike iframe img main nav footer header article aside button cite dd dl dt h1 h2 h3 h4 h5 h6".split()
# What a drafter asks for in brackets, what is asked for, and what is yet to happen.
ASKED = ["insert", "enter", "type", "add", "your", "fill in", "click", "to be", "tba", "tbc", "tbd"]
WANTED = ["name", "title", "date", "number", "address", "amount", "signature", "designation", "place"]
PENDING = ["confirmed", "inserted", "completed", "added", "determined", "advised", "decided", "filled", "filled in", "supplied", "provided"]


def _either(words: list[str]) -> str:
    return "|".join(regex.escape(w) for w in words)


#: The forms of a slot by the characters that open it; each is tried where its opening stands.
SLOT_FORMS = {
    "{{": [r"\{\{\s*[\w.\- |:]{1,80}?\s*\}\}"],
    "{%": [r"\{%[^%{}]{1,120}%\}"],
    "<%": [r"<%[=-]?[^%<>]{1,120}%>"],
    "${": [r"\$\{\s*[\w.\- ]{1,80}\}"],
    "%(": [r"%\(\w[\w. \-]{0,80}\)[sdrf]"],
    "%": [r"%\w{2,60}%", r"(?<![\w%])%[sd](?!\w)"],
    "@@": [r"@@\w[\w.\- ]{0,80}@@"],
    "__": [r"(?<!\w)__[a-z][\w.\-]{0,80}?__(?!\w)"],
    "[[": [r"\[\[\s*[\w.\- ]{1,80}\]\]"],
    "<<": [r"<<\s*[\w.\- ]{1,80}>>"],
    "$": [r"(?<![\w$])\$[a-z][\w.\-]{1,80}\$(?!\w)"],
    "#": [r"(?<![\w\#])\#[a-z][\w.\-]{1,80}\#(?!\w)"],
    "{": [r"(?<![\w{$\"])\{[a-z][\w.\-]{1,80}\}", r"\{\d{1,2}\}"],
    "[": [
        rf"\[(?:{_either(ASKED)})\b[^\[\]\n]{{0,100}}\]",
        rf"\[[^\[\]\n]{{0,100}}\b(?:to be (?:{_either(PENDING)})|goes? here|here|tba|tbc|tbd)\]",
        r"\[\s*[●•■▪◆]+\s*\]",
        rf"\[(?:{_either(WANTED)}) of [^\[\]\n]{{1,80}}\]",
        rf"\[(?:{_either([w for w in WANTED if w != 'designation'])})\]",
        r"\[object object\]",
    ],
    "<": [
        r"<(?:insert|enter|your|add|type)\b[^<>\n]{0,100}>",
        r"<[\w.\- ]{1,80} here>",
        r"<\s*(?:heading|title|name|date|text|number|amount|address|section|act|court|party)(?:[_. ]\w{1,40})?\s*>",
        rf"<(?!(?:{_either(ELEMENTS)})\s*>)[a-z]+(?:[_.\- ][a-z]+){{0,3}}>",
    ],
    "(to be ": [rf"\(to be (?:{_either([w for w in PENDING if w not in ('advised', 'provided')])})\b[^()\n]{{0,100}}\)"],
    "(insert ": [r"\(insert [^()\n]{1,100}\)"],
    "(enter ": [r"\(enter [^()\n]{1,100}\)"],
    "(fill in ": [r"\(fill in [^()\n]{1,100}\)"],
    "todo": [r"\btodo\s*:", r"\btodo\b(?= replace)"],
    "fixme": [r"\bfixme\s*:"],
    "nan-nan-nan": [r"\bnan-nan-nan\b"],
    "nan/nan/nan": [r"\bnan/nan/nan\b"],
    "xxxxx": [r"(?<![a-z])x{5,}(?![a-z])"],
    "xx/xx/xxxx": [r"\bxx/xx/xxxx\b"],
    "dd/mm/yyyy": [r"\bdd/mm/yyyy\b"],
    "click here to enter ": [r"click here to enter (?:text|a date)"],
}
#: What a program writes for a value it lacks, and the words a value would follow.
BARE_VALUES = ["undefined", "null", "nan", "n/a", "tbc", "tbd"]
BARE_AFTER = ["of", "under", "between", "dear", "on", "in the matter of", "by", "to"]


@lru_cache(maxsize=1)
def _forms() -> dict[str, regex.Pattern]:
    forms = {opening: "|".join(forms) for opening, forms in SLOT_FORMS.items()}
    for value in BARE_VALUES:
        v = regex.escape(value)
        forms[value] = rf"(?<=\b(?:{_either(BARE_AFTER)}) ){v}(?=[ ,.:;]|$)(?! \w+ (?:of|shall))|(?:(?<![\s\S])|(?<=[.:;] )){v}(?=[:,])"
    return {opening: regex.compile(form, regex.V0) for opening, form in forms.items()}


def normalised(text: str) -> str:
    """Lower case, without accents and invisible characters, entities of markup signs read, white space as one space."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        text = regex.sub(r"[\p{Mn}\p{Cf}]+", "", text).replace("’", "'").replace("‘", "'").replace("ʼ", "'")
    if "&" in text:
        text = text.replace("&lt;", "<").replace("&gt;", ">").replace("&quot;", '"').replace("&#39;", "'").replace("&amp;", "&")
    return " ".join(text.lower().split())


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    entries: dict[str, tuple[str, str, int]] = {}
    made = [f"{x} {y}" for subject in SCRIPT_SUBJECTS for x, y in [*((a, subject) for a in SCRIPT_ASKED), *((subject, t) for t in SCRIPT_STATED)]]
    for kind, block in (("script", "|".join([SCRIPT, *made])), ("error", ERROR), ("filler", FILLER)):
        for phrase in block.replace("\n", "|").split("|"):
            if phrase.strip():
                p = normalised(phrase)
                entries[p] = (kind, "phrase", len(p))
    for word in LATIN:
        entries.setdefault(word, ("filler", "latin", len(word)))
    for reason in REASONS:
        entries.setdefault(reason, ("error", "status", len(reason)))
    for opening in _forms():
        entries.setdefault(opening, ("slot", "slot", len(opening)))
    for key, value in entries.items():
        found.add_word(key, value)
    found.make_automaton()
    return found


#: Dummy Latin words that must stand within so many characters of each other to count.
LATIN_WORDS, LATIN_SPAN = 4, 120


def findings(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in the normalised text; kinds: slot, filler, error, script."""
    out: list[tuple[str, int, int]] = []
    latin: list[tuple[int, int]] = []
    done = 0  # slots do not overlap
    for end, (kind, how, size) in automaton().iter(text):
        start = end + 1 - size
        if how == "phrase":
            out.append((kind, start, end + 1))
        elif how == "latin":
            if start == 0 or not text[start - 1].isalpha():
                latin.append((start, end + 1))
        elif how == "status":
            m = _STATUS.search(text, max(0, start - 40), start)
            if m and not text[end + 1 : end + 2].isalpha():
                out.append((kind, m.start(), end + 1))
        elif start >= done and (m := _forms()[text[start : end + 1]].match(text, start)):
            out.append(("slot", start, m.end()))
            done = m.end()
    for i in range(len(latin) - LATIN_WORDS + 1):
        if latin[i + LATIN_WORDS - 1][1] - latin[i][0] <= LATIN_SPAN and len({text[s:e] for s, e in latin[i : i + LATIN_WORDS]}) > 1:
            out.append(("filler", latin[i][0], latin[i + LATIN_WORDS - 1][1]))
    return out


def coverage(spans: list[tuple[str, int, int]], size: int) -> float:
    """Share of the text under findings; each counts with the rest of its sentence's reach of 40 characters."""
    done, covered = 0, 0
    for _, a, z in sorted(spans, key=lambda s: s[1]):
        a, z = max(a, done), min(z + 40, size)
        if z > a:
            covered += z - a
            done = z
    return covered / size if size else 0.0


def _scan(batches: Iterator[pa.RecordBatch], limit: float, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[list] = [[], [], [], [], []]
        for i, text in enumerate(plain(b.column(1)).to_pylist()):
            if not text:
                continue
            t = normalised(text)
            spans = findings(t)
            if spans:
                share = coverage(spans, len(t))
                for o, v in zip(out, (i, sorted({k for k, _, _ in spans}), len(spans), share, share >= limit)):
                    o.append(v)
        if out[0]:
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(out[0])), *[pa.array(o, f.type) for o, f in zip(out[1:], list(schema)[1:])]], schema=schema)


def residue(docs: DataFrame, doc_id: str, text: str, exclude_from: float = 0.5) -> DataFrame:
    """(doc_id, kinds, findings, coverage, exclude) of every document with residue; exclude where coverage >= exclude_from.

    Null, empty and blank texts have no residue; repeated rows come out repeated; other columns are ignored. One pass
    without shuffle over whole texts.
    """
    schema = pa.schema([("d", pa.int64()), ("kinds", pa.list_(pa.string())), ("findings", pa.int64()), ("coverage", pa.float64()), ("exclude", pa.bool_())])
    found = small_batches(docs).selectExpr(f"cast(`{doc_id}` as bigint) d", f"`{text}`").mapInArrow(
        partial(_scan, limit=exclude_from, schema=schema), "d bigint, kinds array<string>, findings bigint, coverage double, exclude boolean"
    )
    return found.withColumnRenamed("d", doc_id)
