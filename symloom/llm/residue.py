"""Template residue, filler, error pages and notices that scripts are required.

An automaton (Aho-Corasick) of short terms in several languages marks paragraphs that hold what such pages are told by (anchors: a status phrase, a
word for scripts, a word of filler); in these a second automaton of the whole vocabulary of such pages measures how much of the
paragraph's content words it covers. High coverage tells residue: a text that discusses an error has words of its own. Filler without
telling terms is found by statistics: words that repeat, and words with Latin endings without any function word of a living
language. A placeholder that stands unfilled or was filled with a non-value is residue wherever it stands.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of a paragraph's content letters that the vocabulary must cover.
COVERED = 0.7
#: Words from which on statistics are asked, the share of distinct words up to which a paragraph only repeats itself, and for
#: Latin the share of words with its endings and of function words of living languages.
LEAST_WORDS, DISTINCT, LATIN, LIVING = 6, 0.34, 0.8, 0.05

# What error pages, script notices and filler are told by, as web servers, frameworks, browsers and page builders put it.
ERROR_ANCHORS = """
not found|page not found|no such page|no such item|no such key|forbidden|bad gateway|gateway timed out|gateway timeout|service unavailable|temporarily unavailable|temporarily down|server fault|server error|internal server error
too many requests|sign-in required|login required|unauthorized|gone|access denied|permission denied|request timeout|timed out|method not allowed|bad request|error 0|http 0|error code|status 0|oops|something went wrong|something broke
session has ended|session has expired|session expired|we could not|could not be found|could not be completed|cannot be displayed|does not exist|upstream host|upstream server|unexpected error
fehler 0|seite nicht gefunden|zugriff verweigert|serverfehler|erreur 0|page introuvable|page non trouvée|accès refusé|erreur interne|error interno|no pudo atender|página no encontrada|acceso denegado
pagina non trovata|accesso negato|página não encontrada|acesso negado|pagina niet gevonden|nie została znaleziona|страница не найдена|页面不存在|ページが見つかりません
""".strip().replace("\n", "|").split("|")
SCRIPT_ANCHORS = "javascript|scripts|scripting|checking that you are human|checking your browser|cookies".split("|")
FILLER_ANCHORS = """
lorem ipsum|goes here|go here|placeholder|dummy|sample|coming soon|under construction|not been written|to be written|will follow|only here to show|here to show the layout|your text|own text|own content|in the editor|insert
blindtext|platzhaltertext|hier steht|aquí irá|próximamente|texto de ejemplo|à venir|texte de remplissage|testo segnaposto|in arrivo|texto de exemplo|em breve|asdf|qwer|blah|foo bar baz
""".strip().replace("\n", "|").split("|")
# The further words of such pages. A word's end may vary: `find` stands for finding, `server` for servers.
ERROR_WORDS = """
error http status code page address link url site website web server host gateway upstream proxy response answer request requests session login log sign sign-in service services item document file resource content name
find found look message once more exist moved removed withdrawn deleted mistyped typed expired ended lost gone old here never denied forbidden blocked unauthorized allowed permission rights right access account view show display lack enough
broke broken wrong unexpected internal fault failed complete completed unavailable temporarily temporary maintenance repair repaired down busy overload limit many much usable reply respond response timed timeout time out load loading again later soon
try retry reload refresh return wait back start home homepage search box map menu contact write support administrator admin operator owner team quote id ray reference number told notified report sorry oops please minute minutes second seconds moment help
asked ask wanted requested visit go come get got seen see side end continue
fehler seite gewünschte nicht gefunden gibt zurück startseite zugriff verweigert versuchen später erneut serverfehler interner erreur droit voir page introuvable trouvée retour accueil réessayez plus tard accès refusé interne serveur
error servidor pudo atender petición inténtelo tarde más página encontrada acceso denegado interno pagina trovata accesso negato não encontrada negado niet gevonden strona została znaleziona страница не найдена
""".split()
SCRIPT_WORDS = """
javascript script scripts scripting enable enabled disable disabled active activate activated turn switch switched required require requires needs need must run running allow allowed block blocked off on works work without browser browsers viewer
rely relies only app application page site content document documentation docs view see shown show drawn load graph continue please old too listed supported below help explained cookies cookie blank stays human checking check takes seconds noticed again try reload on your
bitte aktivieren aktiviert seite sehen anzuzeigen deaktiviert activez activer afficher document veuillez navigateur para ver contenido active activar navegador habilite attiva visualizzare ative conteúdo schakel włącz obsługę включите
""".split()
FILLER_WORDS = """
text title heading headline subtitle caption abstract intro introduction summary description paragraph list item link content section name body image picture table quote footer header label page module layout editor
test goes go here placeholder dummy sample example replace replaced insert add added more own written write yet coming soon follow construction show only one two three four five first second third lorem ipsum
blindtext platzhaltertext später steht hier modul aquí irá contenido sección próximamente texto ejemplo titre texte venir remplissage testo segnaposto exemplo asdf qwer qwerty blah foo bar baz
""".split()
# Function words of living languages, which texts in them can't do without.
FUNCTION_WORDS = frozenset(
    """the of and to a is that it for on with was at by be this from or are an which you not have has will can if all when but their they one there we our your its into so than then them these those no do does i he she as in been being
    had may who what more about up out only also after before would could should must were
    der die das und ist nicht mit auf für von den dem ein eine einer zu sich des im wird sind auch bei als er sie es wir ihr aus nach noch nur oder aber wenn dass
    el la los las una por para que del se al lo como más pero sus su este esta son le les est pas dans qui avec au aux ce cette par plus il elle nous vous mais sur un et du une
    gli di per non con della sono che questo alla nel dei uma não um os da em ao mais het een van zijn niet op te met voor dat w z na się nie jest i do""".split()
)
#: Of these, words that are Latin too can't speak against it.
_LATIN_TOO = frozenset("a e i o in et te me es as os non per ex at is se do una nos via lo la le si est sit ad ut".split())
_LATIN_END = re.compile(r"(?:us|um|is|it|at|et|ut|am|em|im|es|os|as|or|ur|nt|ae|a|o|i|u)$")

# Parts of a page around the text: neither residue nor content.
_AROUND = re.compile(r"^\s*(?:back to top|menu\s+search\s+sign in|skip to (?:main )?content|share this page|home(?:\s*>\s*[\w -]+)+|(?:\(c\)|©)\s.{1,60}|all rights reserved)\s*\.?\s*$", re.I)
_PAGE = re.compile(r'^\s*(?:<(?:\?xml[^>]*>\s*<)?error>.*</error>|\{\s*"(?:error|status|code|message)"\s*:[^{}]*"(?:error|status|code|message|path)"\s*:[^{}]*\}|status=\d{3}\s+message="[^"]*".*)\s*$', re.I | re.S)
_NAME = r"[A-Za-z][\w-]*(?:\.\w+)*"
def _held(excluded: str) -> str:
    """What a delimited form holds: any length, without the excluded signs and blank lines."""
    return rf"(?:[^{excluded}\n]|\n(?![^\S\n]*\n))"


# Forms of placeholders, each under the sign that begins it; what stands before the sign is looked at behind it.
PLACEHOLDERS = {
    "{": (
        r"\{\{\{?(?=[^{}]*[^{}\n])\s*+" + _held("{}") + r"*+\s*+\}?\}\}",  # {{ name }}
        r"\{(?<![\w$#{%\\]\{)(?:[A-Za-z_][\w.]*|\d{1,2})\}(?![\w}])",  # {name} {0}
        r"\{%" + _held("%{}") + r"+%\}",
        rf"\{{(?<=[$#]\{{)\s*{_NAME}\s*\}}",  # ${{NAME}} #{{name}}
    ),
    "<": (r"<%[=-]?" + _held("%<>") + "+%>", rf"<<\s*{_NAME}\s*>>", r"<(?:your|insert|enter)[-_ ]" + _held("<>") + "+>", r"<" + _held("<>/") + r"+\bgoes here>"),
    "[": (rf"\[\[\s*{_NAME}\s*\]\]", r"\[(?:INSERT|ENTER|ADD|YOUR|REPLACE|FILL IN)\b" + _held(r"\[\]") + r"*\]", r"\[(?:insert|enter|your|replace|fill in|add your)\s" + _held(r"\[\]") + r"+\]", r"\[object Object\]"),
    "$$": (rf"\$\$\s*{_NAME}\s*\$\$",),
    "@@": (rf"@@\s*{_NAME}\s*@@",),
    "__": (r"__(?<![\w*]__)[A-Z][A-Z0-9_.]*?__(?!\w)",),
    "%": (r"%(?<![\w%]%)[A-Z][A-Z0-9_.]*%(?![\w%])", r"%\(\w[\w.]*\)[sdif]"),
    "TODO_": (r"TODO_(?<!\wTODO_)[A-Z][A-Z0-9_.]*\b",),
    "XXXX": (r"XXXX(?<!\wXXXX)X*(?!\w)",),
    "TKTK": (r"TKTK(?<!\wTKTK)(?!\w)",),
    "TB": (r"TB(?<!\wTB)[DA](?!\w)",),
    "T.B.D.": (r"T\.B\.D\.(?<!\wT\.B\.D\.)(?!\w)",),
    "X.Y.Z": (r"X\.Y\.Z(?<!\wX\.Y\.Z)\b",),
    "Invalid Date": (r"Invalid Date(?<!\wInvalid Date)\b",),
}
PLACEHOLDERS = {sign: tuple(re.compile(f) for f in forms) for sign, forms in PLACEHOLDERS.items()}
#: A bare non-value is residue unless the sentence talks about it: these words stand beside it then.
_NON_VALUE = re.compile(r"(?<![\w.:/_-])(undefined|NaN|null|NULL)(?![\w(:/_-]|\.\w)")
_ABOUT_BEFORE = frozenset("is are was were be been being or and not a an the no returns return returned as of type equals equal become becomes became isn't if than nor either both means gives when".split())
_ABOUT_AFTER = frozenset("or and value values check checks behaviour behavior pointer pointers reference references type types is are was means nor result results".split())
_FENCE = re.compile(r"^[ ]{0,3}(`{3,}|~{3,})[^\n]*\n.*?(?:^[ ]{0,3}\1[`~]*[ \t]*$|\Z)", re.M | re.S)
_SPAN = re.compile(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.S)
_TAG = re.compile(r"</?[a-zA-Z][^<>\n]{0,80}>")
_DIGITS = re.compile(r"\d+")
_WORDS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")


def outside_code(text: str) -> str:
    """The text with code blocks and code spans replaced by a mark; a span doesn't run over a blank line."""
    text = text.replace("\r\n", "\n").replace("\r", "\n").replace("﻿", "")
    text = _FENCE.sub("\n\x00\n", text)
    return "\n\n".join(_SPAN.sub("\x00", p) for p in re.split(r"\n[ \t]*\n", text))


def _automaton(groups: dict[str, list[str]]) -> ahocorasick.Automaton:
    """An automaton of the terms of each group; a term gives its length and its groups."""
    of: dict[str, set[str]] = {}
    for group, terms in groups.items():
        for t in terms:
            of.setdefault(t, set()).add(group)
    a = ahocorasick.Automaton()
    for t, kinds in of.items():
        a.add_word(t, (len(t), frozenset(kinds)))
    a.make_automaton()
    return a


_machines: tuple[ahocorasick.Automaton, ahocorasick.Automaton] | None = None


def _plain(paragraph: str) -> str:
    s = _TAG.sub(" ", html.unescape(paragraph)) if "<" in paragraph or "&" in paragraph else paragraph
    return " ".join(_DIGITS.sub("0", s.replace("’", "'").replace("\xa0", " ").lower()).split())


def _at_words(machine: ahocorasick.Automaton, s: str, whole: bool) -> Iterator[tuple[int, int, frozenset]]:
    """(start, end, groups) of terms that begin at a word's start; with `whole` they end at a word's end, else endings of up to three letters may follow."""
    n = len(s)
    for last, (length, groups) in machine.iter(s):
        a, b = last - length + 1, last + 1
        if a and s[a].isalnum() and s[a - 1].isalnum():
            continue
        if b < n and s[b].isalnum() and s[last].isalnum() and ord(s[last]) < 0x3000:
            e = b
            while e < n and s[e].isalnum():
                e += 1
            if whole or e - b > 3:
                continue
            b = e
        yield a, b, groups


def _statistics(s: str) -> bool:
    """Whether a paragraph is filler by its words alone: it only repeats itself, or it is Latin in no one's language."""
    words = _WORDS.findall(s)
    n = len(words)
    if n < LEAST_WORDS or "\x00" in s:
        return False
    if len(set(words)) <= DISTINCT * n and sum(map(len, set(words))) >= 4:
        return len({x for x in words if x not in FUNCTION_WORDS}) <= max(3, DISTINCT * n / 2)
    living = sum(w in FUNCTION_WORDS and w not in _LATIN_TOO for w in words)
    return living <= LIVING * n and sum(_LATIN_END.search(w) is not None for w in words) >= LATIN * n


def paragraph_kind(paragraph: str) -> str | None:
    """error, script or filler if the paragraph is nothing but that, else None."""
    global _machines
    if _machines is None:
        vocabulary = {"error": [*ERROR_ANCHORS, *ERROR_WORDS], "script": [*SCRIPT_ANCHORS, *SCRIPT_WORDS], "filler": [*FILLER_ANCHORS, *FILLER_WORDS]}
        _machines = _automaton({"error": ERROR_ANCHORS, "script": SCRIPT_ANCHORS, "filler": FILLER_ANCHORS}), _automaton(vocabulary)
    lines = [x for x in paragraph.split("\n") if x.strip() and not _AROUND.match(x)]
    if not lines:
        return None
    told = any(_PAGE.match(x) for x in lines if "=" in x or "{" in x or "<" in x)
    if told:
        lines = [x for x in lines if not _PAGE.match(x)]
        if not lines:
            return "error"
    elif _PAGE.match(paragraph):
        return "error"
    s = _plain("\n".join(lines))
    anchors = {k for _, _, kinds in _at_words(_machines[0], s, True) for k in kinds}
    if told:
        anchors.add("error")
    if not anchors:
        return "filler" if _statistics(s) else None
    covered = {k: bytearray(len(s)) for k in anchors}
    for a, b, kinds in _at_words(_machines[1], s, False):
        for k in kinds & anchors:
            covered[k][a:b] = b"\1" * (b - a)
    words = [(m.start(), m.end()) for m in _WORDS.finditer(s) if m[0] not in FUNCTION_WORDS]
    total = sum(b - a for a, b in words) + 3 * s.count("\x00")
    for k in ("error", "script", "filler"):
        if k in anchors and total and sum(sum(covered[k][a:b]) for a, b in words) >= COVERED * total:
            return k
    return "filler" if _statistics(s) else None


def placeholder(text: str) -> bool:
    """A placeholder stands in the text (without code), unfilled or filled with a non-value."""
    for sign, forms in PLACEHOLDERS.items():
        if sign in text and any(f.search(text) for f in forms):
            return True
    for m in _NON_VALUE.finditer(text):
        before = re.findall(r"[\w'’]+", text[max(0, m.start() - 30) : m.start()].split("\n")[-1])
        after = re.findall(r"[\w'’]+", text[m.end() : m.end() + 30].split("\n")[0])
        if not ((before and before[-1].lower() in _ABOUT_BEFORE) or (after and after[0].lower() in _ABOUT_AFTER and text[m.end() : m.end() + 1] == " ")):
            return True
    return False


def kinds(text: str | None) -> list[str]:
    """What residue a text holds: of placeholder, filler, error, script; empty for null and empty texts."""
    if not text:
        return []
    text = outside_code(text)
    found = {"placeholder"} if placeholder(html.unescape(text)) else set()
    for p in text.split("\n\n"):
        if p.strip():
            found.add(paragraph_kind(p))
    return sorted(found - {None})


def residue(documents: DataFrame) -> DataFrame:
    """(doc_id, kinds) of the documents with residue; whole texts are read, other columns ignored.

    Null and empty texts hold none, rows without doc_id are left out; repeated rows give one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            found = [(d, k) for d, t in zip(x.column(0).to_pylist(), x.column(1).to_pylist()) if (k := kinds(t))]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([k for _, k in found], pa.list_(pa.string()))], ["doc_id", "kinds"])

    docs = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    return docs.mapInArrow(run, "doc_id long, kinds array<string>").distinct()
