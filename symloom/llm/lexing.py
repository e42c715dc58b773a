"""Lexers of the seven source languages.

A file becomes a list of terminals: keywords and punctuation by their own spelling, classes of tokens in capitals (ID, NUM, STR,
CHR, operators of equal rank). Comments and blanks vanish. What cannot be a token, or is never closed, becomes BAD.
"""

from __future__ import annotations

import re

# Other spellings of the languages' names.
LANGUAGES = {
    "c": "c", "h": "c", "cpp": "cpp", "c++": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "go": "go", "golang": "go", "java": "java", "python": "python", "py": "python",
    "python3": "python", "rust": "rust", "rs": "rust", "typescript": "typescript", "ts": "typescript", "tsx": "typescript", "javascript": "typescript", "js": "typescript", "jsx": "typescript",
}

# Reserved words of the languages.
KEYWORDS = {
    "python": "and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield",
    "c": "break case continue default do else enum extern for goto if inline register return sizeof static struct switch typedef union volatile while const",
    "cpp": "break case catch class const constexpr continue default delete do else enum explicit export extern for friend goto if inline mutable namespace new noexcept operator override private protected public register return sizeof static static_cast struct switch template this throw try typedef typename union using virtual volatile while",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "java": "abstract assert break case catch class continue default do else enum extends final finally for if implements import instanceof interface native new package private protected public return static super switch synchronized this throw throws transient try volatile while",
    "rust": "as async await break const continue crate dyn else enum extern fn for if impl in let loop match mod move mut pub ref return self static struct super trait type unsafe use where while",
    "typescript": "async await break case catch class const continue debugger default delete do else enum export extends finally for function if implements import in instanceof let new of return static super switch this throw try typeof var void while with yield interface type as satisfies from keyof readonly infer unique is asserts public private protected get set override abstract declare accessor namespace",
}
KEYWORDS = {k: frozenset(v.split()) for k, v in KEYWORDS.items()}
#: Words that name values or types: classes of their own would add nothing.
CONSTANTS = {"python": frozenset(("None", "True", "False"))}

# Directives of the C preprocessor; the empty one is allowed.
DIRECTIVES = frozenset("include define undef if ifdef ifndef else elif elifdef elifndef endif line error warning pragma import include_next ident embed".split()) | {""}
_DIRECTIVE = re.compile(r"[ \t]*(\w*)(?:[^\n\\]|\\[\s\S])*")

_NUM = r"(?P<NUM>0[xX][0-9a-fA-F_']+[uUlLn]*|0[bB][01_']+[uUlLn]*|0[oO][0-7_]+|(?:\d[\d_']*\.?[\d_']*|\.\d[\d_]*)(?:[eE][+-]?\d+)?(?:[a-zA-Z]\w*)?)"
_ID = r"(?P<ID>[^\W\d]\w*)"
_DQ = r'"(?:[^"\\\n]|\\[\s\S])*"'
_SQ = r"'(?:[^'\\\n]|\\[\s\S])*'"
_BLOCK = r"/\*[\s\S]*?\*/"
_OPS_C = r"(?P<OP><<=|>>=|\.\.\.|->\*?|::|<=>|<<|[-+*/%&|^=!<>]=|&&|\|\||\+\+|--|[-+*/%&|^=!<>~?:;,.(){}\[\]#@\\])"
_WS = r"[ \t\r\f\v﻿]+"


def _make(*parts: str) -> re.Pattern:
    return re.compile("|".join(parts))


_PATTERNS = {
    "c": _make(r"(?P<NL>\n)", _WS, r"//(?:[^\n\\]|\\[\s\S])*", _BLOCK, r"(?P<BAD>/\*)", rf"(?P<STR>(?:u8|[uUL])?{_DQ})", rf"(?P<CHR>[uUL]?{_SQ})", _NUM, r"(?P<ID>[^\W\d][\w$]*)", _OPS_C),
    "cpp": _make(r"(?P<NL>\n)", _WS, r"//(?:[^\n\\]|\\[\s\S])*", _BLOCK, r"(?P<BAD>/\*)", rf'(?P<STR>(?:u8|[uUL])?R"(?P<_d>[^()\\\s]{{0,16}})\([\s\S]*?\)(?P=_d)"|(?:u8|[uUL])?{_DQ}\w*)', r'(?P<BAD2>(?:u8|[uUL])?R")', rf"(?P<CHR>(?:u8|[uUL])?{_SQ})", _NUM, _ID, _OPS_C),
    "go": _make(r"(?P<NL>\n)", _WS, r"//[^\n]*", r"(?P<BLK>/\*[\s\S]*?\*/)", r"(?P<BAD>/\*)", rf"(?P<STR>{_DQ}|`[^`]*`)", rf"(?P<CHR>{_SQ})", _NUM, _ID, r"(?P<OP><<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|&\^|<<|>>|:=|[-+*/%&|^=!<>]=|[-+*/%&|^=!<>~:;,.(){}\[\]])"),
    "java": _make(r"(?P<NL>\n)", _WS, r"//[^\n]*", _BLOCK, r"(?P<BAD>/\*)", r'(?P<STR>"""[ \t]*\r?\n(?:[^"\\]|\\[\s\S]|"(?!""))*"""|' + r'"(?!"")(?:[^"\\\n]|\\[\s\S])*"' + r'|""(?!"))', rf"(?P<CHR>{_SQ})", _NUM, r"(?P<ID>[^\W\d][\w$]*|\$[\w$]*)", r"(?P<OP>>>>=|<<=|>>=|\.\.\.|->|::|<<|[-+*/%&|^=!<>]=|&&|\|\||\+\+|--|[-+*/%&|^=!<>~?:;,.(){}\[\]@])"),
    "rust": _make(r"(?P<NL>\n)", _WS, r"//[^\n]*", r"(?P<NEST>/\*)", r'(?P<STR>b?r(?P<_h>#*)"[\s\S]*?"(?P=_h)|[bc]?"(?:[^"\\]|\\[\s\S])*")', r"(?P<CHR>b?'(?:[^'\\\n]|\\(?:u\{[^}\n]*\}|x..|[^\n]))')", r"(?P<LIFE>'[^\W\d]\w*)", r"(?P<NUM>0[xob][\w]+|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?\d+)?(?:[a-z]\w*)?)", r"(?P<ID>(?:r#)?[^\W\d]\w*)", r"(?P<OP><<=|>>=|\.\.=|\.\.\.|\.\.|->|=>|::|<<|[-+*/%&|^=!<>]=|&&|\|\||[-+*/%&|^=!<>~?:;,.(){}\[\]#@$])"),
    "typescript": _make(r"(?P<NL>\n)", _WS, r"//[^\n]*", r"(?P<BLK>/\*[\s\S]*?\*/)", r"(?P<BAD>/\*)", rf"(?P<STR>{_DQ}|{_SQ})", r"(?P<TPL>`)", _NUM, r"(?P<ID>[#]?(?:[^\W\d]|\$)[\w$]*)", r"(?P<OP>>>>=|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|===|!==|\.\.\.|=>|\?\.(?!\d)|\?\?|\*\*|<<|[-+*/%&|^=!<>]=|&&|\|\||\+\+|--|[-+*/%&|^=!<>~?:;,.(){}\[\]@])"),
    "python": _make(r"(?P<NL>\r?\n|\r)", r"[ \t\f﻿]+", r"#[^\n\r]*", r"(?P<CONT>\\\r?\n)", r"(?P<STR>(?:[rRbBuUfFtT]{1,2})?(?:'''(?:[^\\]|\\[\s\S])*?'''|\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'(?!'')(?:[^'\\\n]|\\[\s\S])*'|\"(?!\"\")(?:[^\"\\\n]|\\[\s\S])*\"|''(?!')|\"\"(?!\")))",
                    r"(?P<NUM>0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.?)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)", _ID, r"(?P<OP>\*\*=|//=|<<=|>>=|\.\.\.|:=|->|\*\*|//|<<|>>|[-+*/%&|^=!<>@]=|[-+*/%&|^=<>~:;,.(){}\[\]@])"),
}
_CLASS_C = {"+": "PM", "-": "PM", "++": "INC", "--": "INC"} | {x: "BOP" for x in "/ % | ^ == != <= >= && || << >> <=> >>> ** === !== ??".split()} | {x: "AOP" for x in "+= -= *= /= %= &= |= ^= <<= >>= >>>= **= &&= ||= ??= &^=".split()}
_CLASS = {
    "python": {"+": "PM", "-": "PM", "<": "BOP", ">": "BOP", "&": "BOP", "//": "BOP", "@=": "AOP", "//=": "AOP"} | {k: v for k, v in _CLASS_C.items() if k not in ("++", "--", "**", "+", "-")},
    "go": _CLASS_C | {"&^": "BOP", "^": "PM"},
    "rust": {k: v for k, v in _CLASS_C.items() if k not in ("|", "||", "&&", "<<", "-", "+")} | {"-": "-", "+": "+", "&&": "&&", "<<": "BOP", "..=": ".."},
    "java": _CLASS_C, "c": _CLASS_C, "cpp": _CLASS_C, "typescript": _CLASS_C,
}
_LEADING_ZERO = re.compile(r"0[\d_]*[1-9][\d_]*$|0[\d_]+$")


def _template(text: str, i: int) -> int:
    """End of a template literal that begins at i, or -1."""
    i += 1
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 2
        elif c == "`":
            return i + 1
        elif text.startswith("${", i):
            depth, i = 1, i + 2
            while i < len(text) and depth:
                if text[i] == "`":
                    i = _template(text, i)
                    if i < 0:
                        return -1
                    continue
                if text[i] in "\"'":
                    q = re.compile(_DQ if text[i] == '"' else _SQ).match(text, i)
                    i = q.end() if q else i + 1
                    continue
                depth += {"{": 1, "}": -1}.get(text[i], 0)
                i += 1
        else:
            i += 1
    return -1


_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_ENDS_EXPR = frozenset(("ID", "NUM", "STR", "CHR", ")", "]", "}", "this", "super", "INC"))
_GO_ENDS = frozenset(("ID", "NUM", "STR", "CHR", ")", "]", "}", "INC", "break", "continue", "fallthrough", "return"))
_TS_ENDS = frozenset(("ID", "NUM", "STR", ")", "]", "}", "INC", "break", "continue", "return", "this", "super", "debugger"))
_TS_GOES_ON = frozenset(("BOP", "PM", "*", "&", "<", ">", "AOP", "=", "=>", "?", ":", ".", "?.", ",", "(", "[", ")", "]", "}", ";", "in", "instanceof", "else", "catch", "finally", "while", "of", "extends", "implements", "{", "as", "satisfies", "is"))


def lex(lang: str, text: str, spellings: bool = False) -> list:
    """Terminals of a text, or (terminal, spelling) pairs; BAD stands for what is no token."""
    pattern, words, classes = _PATTERNS[lang], KEYWORDS[lang], _CLASS[lang]
    out: list[tuple[str, str]] = []
    i, n = 0, len(text)
    depth, indents, fresh = 0, [0], True  # Python
    stack: list[str] = []  # open brackets, to tell where a line break ends a statement
    newline, conditions = False, 0

    def end_line() -> None:
        last = out[-1][0] if out else ""
        if lang == "go" and last in _GO_ENDS:
            out.append((";", ""))

    if lang in ("typescript", "rust", "python") and text.startswith("#!") and not text.startswith("#!["):
        i = text.find("\n") if "\n" in text else n
    while i < n:
        if lang == "python" and fresh and not depth:
            m = re.compile(r"(?:[ \t\f﻿]*(?:#[^\n\r]*)?(?:\r?\n|\r))*([ \t\f﻿]*)(?=([^\s#])|)").match(text, i)
            i = m.end()
            if m[2] is None:  # a comment or the end
                rest = re.compile(r"#[^\n\r]*").match(text, i)
                if rest:
                    i = rest.end()
                    continue
                break
            width = len(m[1].replace("﻿", "").expandtabs(8))
            fresh = False
            if width > indents[-1]:
                indents.append(width)
                out.append(("INDENT", ""))
            else:
                while width < indents[-1]:
                    indents.pop()
                    out.append(("DEDENT", ""))
                if width != indents[-1]:
                    out.append(("BAD", ""))
        m = pattern.match(text, i)
        if not m:
            out.append(("BAD", text[i]))
            i += 1
            continue
        kind, s = m.lastgroup, m[0]
        if kind == "_d" or kind == "_h":
            kind = "STR"
        i = m.end()
        if kind is None:
            continue
        if kind == "NL" or (kind == "BLK" and "\n" in s):
            if lang == "python":
                if not depth and out and out[-1][0] not in ("NL", "INDENT", "DEDENT"):
                    out.append(("NL", "\n"))
                fresh = not depth
            elif lang == "go":
                end_line()
            newline = True
            continue
        if kind in ("BLK", "CONT"):
            continue
        if kind in ("BAD", "BAD2"):
            out.append(("BAD", s))
            continue
        if kind == "NEST":  # nested comment
            level = 1
            for x in re.compile(r"/\*|\*/").finditer(text, i):
                level += 1 if x[0] == "/*" else -1
                if not level:
                    i = x.end()
                    break
            else:
                out.append(("BAD", s))
                break
            continue
        if kind == "OP":
            t = classes.get(s, s)
            if s == "#" and lang in ("c", "cpp"):
                if newline or not out:  # a directive, with its continued lines
                    m = _DIRECTIVE.match(text, i)
                    i = m.end()
                    conditions += {"if": 1, "ifdef": 1, "ifndef": 1, "endif": -1}.get(m[1], 0)
                    if m[1] not in DIRECTIVES or conditions < 0 or (m[1] in ("else", "elif") and not conditions):
                        out.append(("BAD", m[0]))
                    continue
            elif lang == "typescript" and s in ("/", "/=") and (not out or out[-1][0] not in _ENDS_EXPR):
                m = _REGEX.match(text, i - len(s))
                if m:
                    i, t, s = m.end(), "STR", m[0]
            if t in "([{":
                depth += 1
                stack.append(t)
            elif t in ")]}":
                depth = max(0, depth - 1)
                if stack:
                    stack.pop()
        elif kind == "ID":
            t = s if s in words else "CONST" if s in CONSTANTS.get(lang, ()) else "ID"
            if s in words and lang in ("typescript", "rust", "java") and out and out[-1][0] in (".", "?."):
                t = "ID" if s != "await" or lang != "rust" else "await"
        elif kind == "TPL":
            e = _template(text, i - 1)
            if e < 0:
                out.append(("BAD", "`"))
                break
            s, t, i = text[i - 1 : e], "STR", e
        elif kind == "NUM":
            t = "NUM"
            if lang == "python" and (_LEADING_ZERO.match(s) and s.strip("0_") or (i < n and (text[i].isalnum() or text[i] == "_"))):
                t = "BAD"
            elif lang in ("c", "cpp", "java", "go", "rust", "typescript") and not re.match(r"0[xXbBoO]", s) and re.fullmatch(r"[\d_']+[a-zA-Z]\w*", s) and not re.fullmatch(r"[\d_']+(?:[uUlLfFdDnimz]{1,3}|[iu](?:8|16|32|64|128|size)|f(?:32|64)|_?[a-z]{1,3})", s):
                t = "BAD"
        else:
            t = kind
        if lang == "typescript" and newline and out and (not stack or stack[-1] == "{") and out[-1][0] in _TS_ENDS and t not in _TS_GOES_ON:
            out.append((";", ""))
        newline = False
        out.append((t, s))
    if conditions:
        out.append(("BAD", "#if"))
    if lang == "python":
        if out and out[-1][0] not in ("NL", "INDENT", "DEDENT"):
            out.append(("NL", ""))
        out += [("DEDENT", "")] * (len(indents) - 1)
    else:
        end_line()
        if lang == "typescript" and out and out[-1][0] in _TS_ENDS and out[-1][0] != "}":
            out.append((";", ""))
    return out if spellings else [t for t, _ in out]
