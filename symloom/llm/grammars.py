"""Grammars of the seven languages, and what is derived from them.

The notation is EBNF: rules, alternatives with |, repetition with * + ?, terminals in quotes or capitals. Brackets come as
(: x :), [: x :], {: x :} and, for indented blocks, <: x :>; only inside these may rules recur, so that what stands at one level of
nesting is a regular language. Two things are derived: the pairs of terminals that may stand side by side, and for each
bracket, by the terminal before it, the pattern of its content in which inner brackets count as one terminal.
"""

from __future__ import annotations

import re
from functools import lru_cache

OPEN, CLOSE = {"(:": "(", "[:": "[", "{:": "{", "<:": "INDENT"}, {":)": ")", ":]": "]", ":}": "}", ":>": "DEDENT"}
#: How deep rules may call each other within one level of brackets.
DEEPEST = 30
PARTNER = {"(": ")", "[": "]", "{": "}", "INDENT": "DEDENT"}

PYTHON = r"""
file = (NL | stmt)*
stmt = small (";" small)* ";"? NL | compound
small = exprs (":" expr)? (("=" | AOP) (exprs | yield))* | yield | "pass" | "break" | "continue" | "return" exprs? | "raise" (expr ("from" expr)?)?
 | ("global" | "nonlocal") ID ("," ID)* | "del" exprs | "assert" expr ("," expr)? | "import" dotted ("as" ID)? ("," dotted ("as" ID)?)*
 | "from" ("." | "...")* dotted? "import" ("*" | names | (: names ","? :))
dotted = ID ("." ID)*
names = ID ("as" ID)? ("," ID ("as" ID)?)*
block = small (";" small)* ";"? NL | NL <: (stmt | NL)+ :>
compound = "if" named ":" block ("elif" named ":" block)* ("else" ":" block)? | "while" named ":" block ("else" ":" block)?
 | "async"? "for" targets "in" exprs ":" block ("else" ":" block)?
 | "try" ":" block (("except" "*"? (expr ("," expr)* ("as" ID)?)? ":" block)+ ("else" ":" block)? ("finally" ":" block)? | "finally" ":" block)
 | "async"? "with" expr ("as" un)? ("," expr ("as" un)?)* ","? ":" block
 | ("@" named NL)* ("async"? "def" ID [: any :]? (: params? :) ("->" expr)? ":" block | "class" ID [: any :]? (: args? :)? ":" block)
any = exprs (":" exprs)? ("," exprs (":" exprs)?)*
params = param ("," param)* ","?
param = ("*" | "**")? ID (":" "*"? expr)? ("=" expr)? | "*" | BOP
lparams = lparam ("," lparam)* ","?
lparam = ("*" | "**")? ID ("=" bin)? | "*"
named = expr (":=" expr)?
targets = "*"? un ("," "*"? un)* ","?
yield = "yield" ("from" expr | exprs)?
exprs = "*"? expr ("," "*"? expr)* ","?
expr = bin ("if" bin "else" bin)*
bin = un ((PM | "*" | "**" | "@" | BOP | "in" | "not" "in" | "is" | "is" "not" | "and" | "or") un)*
un = (PM | "~" | "not" | "await" | "lambda" lparams? ":")* prim ("." ID | (: args? :) | [: subs :])*
prim = ID | CONST | NUM | STR+ | "..." | (: (inside | yield)? :) | [: inside? :] | {: (pair (","pair)* ","? | pair comp | inside)? :}
pair = expr ":" expr | "**" expr
inside = "*"? named ("," "*"? named)* ","? | "*"? named comp
comp = ("async"? "for" targets "in" expr ("if" named)*)+
args = arg ("," arg)* ","?
arg = ID "=" expr | "*" expr | "**" expr | named comp?
subs = sub ("," sub)* ","?
sub = "*"? named | expr? ":" expr? (":" expr?)?
"""

_C_STMTS = r"""
expr = tern (("=" | AOP) (tern | init))*
exprs = expr ("," expr)*
tern = bin ("?" exprs ":" bin)*
bin = un ((PM | "*" | "&" | BOP | "<" | ">") un)*
args = (expr | type | init) ("," (expr | type | init))* ","?
init = {: (item ("," item)* ","?)? :}
item = (("." ID | [: expr :])+ "=")? (expr | init)
head = "if" "constexpr"? (: cond :) | "while" (: cond :) | "switch" (: cond :) | "for" (: forin :) | "do" | label
label = ID ":" | "case" tern ("..." tern)? ":" | "default" ":"
body = {: stmts :} | simple
stmt = head* body ("else" head* body)*
stmts = (stmt | label)*
"""
C = (
    r"""
file = (top | ";")*
top = decl ";" | decl? ID (: params :) attr? {: stmts :} | ID (: args? :)
decl = spec+ declarator? ("," declarator)*
spec = ID | "static" | "extern" | "inline" | "const" | "volatile" | "register" | "typedef" | ("struct" | "union") ID? ({: fields :})? | "enum" ID? ({: enums? :})? | "extern" STR
attr = ID (: args :)
declarator = ("*" | "const" | "volatile")* (ID | (: declarator :)) ((: params :) | [: ("static"? expr)? :])* (":" tern)? ("=" (expr | init))?
fields = (decl ";" | ";")*
enums = ID ("=" tern)? ("," ID ("=" tern)?)* ","?
params = (param ("," param)* ("," "...")?)?
param = spec+ ("*" | "const" | "volatile")* (ID | (: declarator :))? ([: ("static"? expr)? :] | (: params :))*
type = spec+ ("*" | "const")* ((: ("*" ID?)? :) (: params :))? [: expr? :]*
cond = exprs | type declarator
forin = (exprs | decl)? ";" exprs? ";" exprs?
simple = decl ";" | exprs? ";" | "return" (exprs | init)? ";" | "break" ";" | "continue" ";" | "goto" ID ";"
un = (PM | "!" | "~" | "*" | "&" | INC | "sizeof" | (: type :))* prim ((: args? :) | [: exprs :] | "." ID | "->" ID | INC)*
prim = ID | NUM | STR+ | ID STR | STR ID | CHR | (: exprs :) | (: {: stmts :} :) | (: type :) init | "sizeof" (: type :)
"""
    + _C_STMTS
)
CPP = (
    r"""
file = outer
outer = (top | ";")*
top = tmpl* (fn | decl ";" | "namespace" ((ID "::")* ID)? {: outer :} | "inline"? "namespace" ID {: outer :} | "extern" STR {: outer :} | "using" ("namespace"? qual | ID "=" typ | "typename" qual) ";" | "namespace" ID "=" qual ";" | ID (: args? :))
tmpl = "template" "<" (tparam ("," tparam)*)? (">" | ">" ">")
tparam = ("typename" | "class") "..."? ID? ("=" typ)? | typ ID? ("=" tern)?
qual = "::"? ID ("::" "~"? ID)*
typ = (("const" | "typename" | "volatile" | "struct" | "enum" | "class" | "union")* qual targs?) ("::" ID targs?)* ("const" | "*" | "&" | BOP | "...")* ((: fparams :) | [: tern? :])?
targs = "<" (targ ("," targ)*)? ">"+
targ = ("const" | "typename")? (qual | NUM) ("<" (qual | NUM) ("*" | "&")* ("," (qual | NUM) ("*" | "&")*)* ">"*)? ("*" | "&" | "const" | "::" ID | (: fparams :))*
spec = "static" | "extern" | "inline" | "constexpr" | "explicit" | "virtual" | "friend" | "mutable" | "const" | "typedef" | "volatile" | "register" | [: [: args? :] :]
decl = spec* (typ | agg) (declarator ("," declarator)*)?
agg = ("struct" | "class" | "union") ID? "final"? (":" base ("," base)*)? {: members :} | "enum" ("class" | "struct")? ID? (":" typ)? {: (ID ("=" tern)? ("," ID ("=" tern)?)* ","?)? :}
base = "virtual"? ("public" | "private" | "protected")? "virtual"? typ
declarator = ("*" | "&" | BOP | "const")* (qual | (: declarator :) | [: ID ("," ID)* :]) ([: tern? :] | (: fparams :))* (":" tern)? ("=" (expr | init) | init | (: args :))?
members = (("public" | "private" | "protected") ":" | tmpl* (fn | decl ";") | "using" (qual | ID "=" typ) ";" | tmpl* spec* fhead tail ("=" ("default" | "delete" | NUM))? ";" | ";")*
fhead = typ? ("*" | "&")* (qual | "~" ID | "operator" op | qual "::" "operator" op) (: fparams :)
op = PM | "*" | "&" | BOP | "<" | ">" | "=" | AOP | INC | "!" | "~" | "->" | (: :) | [: :] | typ | "<" "<"
fn = spec* fhead tail (":" qual ((: args? :) | init) ("," qual ((: args? :) | init))*)? ({: stmts :} | "try" {: stmts :} ("catch" (: fparams :) {: stmts :})+)
tail = ("const" | "noexcept" (: args? :)? | "override" | "final" | "&" | "->" typ | "volatile" | "throw" (: args? :))*
fparams = ((param ("," param)*)? ("," "...")?)? | "..."
param = ("const" | "register" | "this")* typ (("*" | "&" | BOP)* (ID | (: declarator :)))? [: tern? :]* ((: fparams :))? ("=" (tern | init))?
type = typ
cond = exprs | spec* typ declarator | (exprs | decl) ";" exprs
forin = (exprs | decl)? ";" exprs? ";" exprs? | spec* typ declarator ":" (expr | init) | typ ("&" | "*" | BOP)? (ID | [: ID ("," ID)* :]) ":" (expr | init)
simple = decl ";" | exprs? ";" | "return" (exprs | init)? ";" | "break" ";" | "continue" ";" | "goto" ID ";" | "using" ("namespace"? qual | ID "=" typ) ";" | "try" {: stmts :} ("catch" (: fparams :) {: stmts :})+ | tmpl decl ";" | "throw" expr? ";"
un = (PM | "!" | "~" | "*" | "&" | INC | "sizeof" "..."? | "delete" ([: :])? | "throw" | "new" | "::" | (: typ :))* prim ("..." | (: args? :) | [: exprs :] | ("." | "->") "template"? "~"? ID | INC | init | "::" "~"? ID | "->*" ID)*
prim = ID | NUM | STR+ | CHR | "this" | (: exprs :) | (: typ :) init | "sizeof" (: typ :) | ("static_cast" targs) (: args :) | "operator" op | "typename" qual | "noexcept" (: args :)
 | [: (cap ("," cap)*)? :] ((: fparams :))? ("mutable" | "noexcept" | "constexpr")* ("->" typ)? {: stmts :}
cap = ("&" | "=" | "*")? (ID | "this")? "..."? ("=" expr)?
"""
    + _C_STMTS
)

GO = r"""
file = "package" ID ";" ("import" (imp | (: (imp ";")* imp? :)) ";")* (top ";" | ";")* top?
imp = (ID | ".")? STR
top = "func" ((: params :))? ID [: tparams :]? (: params :) results? ({: stmts :})? | decl
decl = ("var" | "const") (vspec | (: (vspec ";")* vspec? :)) | "type" (tspec | (: (tspec ";")* tspec? :))
vspec = ID ("," ID)* type? ("=" exprs)?
tspec = ID [: tparams :]? "="? type
tparams = ID ("," ID)* (type | "~" type) ("|" type)* ("," ID ("," ID)* type ("|" type)*)* ","?
params = (param ("," param)* ","?)?
param = (ID ("," ID)*)? "..."? type | ID
results = type | (: params :)
type = (prefix)* tbase
prefix = "*" | [: (tern | "...")? :] | "chan" "<-"? | "<-" "chan" | "map" [: type :]
tbase = ID ("." ID)? [: type ("," type)* :]? | "struct" {: (fields ";")* fields? :} | "interface" {: (methods ";")* methods? :} | "func" (: params :) results? | (: type :)
fields = ID ("," ID)* type STR? | "*"? ID ("." ID)? STR?
methods = ID (: params :) results? | ("~"? type) (BOP "~"? type | "|" "~"? type)*
exprs = tern ("," tern)*
expr = tern
tern = un ((PM | "*" | "&" | BOP | "<" | ">" | "<-") un)*
un = (PM | "!" | "*" | "&" | "<-" | "~")* prim ("." (ID | (: ("type" | type) :)) | (: (arg ("," arg)* "..."? ","?)? :) | [: subs :] | lit)*
arg = tern | type
subs = (tern | type) ("," type)* | tern? ":" tern? (":" tern?)?
prim = ID | NUM | STR | CHR | (: tern :) | (: "*"+ tbase :) | "func" (: params :) results? {: stmts :} | [: (tern | "...")? :] type lit? | "map" [: type :] type lit? | "struct" {: (fields ";")* fields? :} lit? | "interface" {: (methods ";")* :} | "chan" "<-"? type
lit = {: (item ("," item)* ","?)? :}
item = (tern | lit) (":" (tern | lit))?
simple = exprs (("=" | ":=" | AOP) exprs)? | exprs INC | exprs (":=" | "=") "range" tern | "range" tern
stmt = simple | decl | "return" exprs? | "break" ID? | "continue" ID? | "fallthrough" | "goto" ID | "go" tern | "defer" tern | {: stmts :} | ifs | fors | switches | ID ":" stmtless
stmtless = (fors | switches | ifs | simple)?
ifs = "if" (simple? ";")? simple {: stmts :} ("else" "if" (simple? ";")? simple {: stmts :})* ("else" {: stmts :})?
fors = "for" (simple? ";" simple? ";" simple? | simple?) {: stmts :}
switches = "switch" (simple? ";")? (simple | ID ":=" tern)? {: cases :} | "select" {: cases :}
cases = (("case" (simple | exprs | types) | "default") ":" inner)*
types = type ("," type)*
inner = (stmt ";" | ";")* stmt?
stmts = (stmt ";" | ";")* stmt?
"""

JAVA = (
    r"""
file = (ann* "package" dotted ";")? ("import" "static"? dotted ("." "*")? ";" | ";")* (tdecl | ";")* | (mods "void" ID (: params :) {: stmts :})
dotted = ID ("." ID)*
ann = "@" dotted ((: (annarg ("," annarg)* ","?)? :))?
annarg = (ID "=")? (tern | ann | {: ((tern | ann) ("," (tern | ann))* ","?)? :})
mods = (ann | "public" | "private" | "protected" | "static" | "final" | "abstract" | "native" | "synchronized" | "transient" | "volatile" | "default")*
tdecl = mods (("class" | "interface" | "@" "interface") ID tparams? ("extends" typ ("," typ)*)? ("implements" typ ("," typ)*)? (ID typ ("," typ)*)? {: members :}
 | "enum" ID ("implements" typ ("," typ)*)? {: (const ("," const)* ","?)? (";" members)? :} | ID ID tparams? (: params :) ("implements" typ ("," typ)*)? {: members :})
const = ann* ID ((: args? :))? ({: members :})?
tparams = "<" tparam ("," tparam)* ">"+
tparam = ID ("extends" typ ("&" typ)*)?
typ = ID targs? ("." ID targs?)* ([: :])* "..."?
targs = "<" (targ ("," targ)*)? ">"*
targ = ann* ("?" (("extends" | "super") targ2)? | targ2)
targ2 = ID ("." ID)* ("<" ("?" | ID ("." ID)*)? (("extends" | "super") ID)? ("," ("?" | ID ("." ID)*))* ("<" ID ("," ID)* ">"*)? ">"*)? ([: :])*
members = (tdecl | mods {: stmts :} | mods tparams? (typ | "void")? ID (: params :) ([: :])* ("throws" typ ("," typ)*)? ("default" annval)? ({: stmts :} | ";") | mods ID {: stmts :} | mods typ var ("," var)* ";" | ";")*
annval = tern | {: (tern ("," tern)*)? :}
var = ID ([: :])* ("=" (expr | init))?
params = ((ann | "final")* typ ann* (ID | "this") ([: :])* ("," (ann | "final")* typ (ID | "this") ([: :])*)*)?
expr = tern (("=" | AOP) tern)*
exprs = expr ("," expr)*
tern = bin ("?" (bin | expr) ":" bin)*
bin = un ((PM | "*" | "&" | BOP | "<" | ">" | ">"+ | "instanceof" "final"?) un)* ("instanceof" "final"? typ ID?)?
args = expr ("," expr)*
init = {: ((expr | init) ("," (expr | init))* ","?)? :}
lam = (ID | (: (ID ("," ID)* | params)? :)) "->"
un = (PM | "!" | "~" | INC | (: typ ("&" typ)* :) | lam)* prim post*
prim = ID | NUM | STR | CHR | "this" | "super" | (: expr :) | ID ([: :])+ "::" "new" | "void" "." "class" | typ "::" | "switch" (: expr :) {: cases :} | {: stmts :}
 | "new" ann* ID targs? ("." ID targs?)* ((: args? :) ({: members :})? | [: expr :] ([: expr? :])* | ([: :])+ init)
post = "." (tcall? ID | "this" | "class" | "super" | "new" ID targs? (: args? :)) | (: args? :) | [: expr? :] | INC | "::" (ID | "new")
tcall = "<" ID ("," ID)* ">"
head = "if" (: expr :) | "while" (: expr :) | "for" (: forin :) | "synchronized" (: expr :) | "do" | ID ":"
forin = (exprs | "final"? typ var ("," var)*)? ";" expr? ";" exprs? | ann* "final"? typ ID ":" expr
body = {: stmts :} | simple | "try" ((: (("final"? typ ID "=" expr | expr) (";" ("final"? typ ID "=" expr | expr))* ";"?) :))? {: stmts :} ("catch" (: "final"? typ (BOP typ | "|" typ)* ID :) {: stmts :})* ("finally" {: stmts :})? | "switch" (: expr :) {: cases :} | tdecl
cases = (label (stmts1)*)*
label = ("case" (tern | typ ID) ("," (tern | typ ID))* | "default") (":" | "->")
stmts1 = stmt
stmt = head* body ("else" head* body)*
stmts = stmt*
simple = (ann | "final")* typ var ("," var)* ";" | expr? ";" | "return" expr? ";" | "break" ID? ";" | "continue" ID? ";" | "throw" expr ";" | "assert" expr (":" expr)? ";" | ID expr ";"
"""
)

RUST = r"""
file = inner* items
items = (attr* vis? item | ID "!" ID? ((: margs :) ";" | [: margs :] ";" | {: mbody :}))*
inner = "#" "!" [: meta :]
attr = "#" [: meta :]
meta = path ("=" (STR | path) | (: metas? :))?
metas = (meta | STR | NUM) ("," (meta | STR | NUM))* ","?
vis = "pub" ((: "crate" | "super" | "self" | "in" path :))?
item = "use" "::"? usetree ";" | "mod" ID (";" | {: inner* items :}) | ("const" | "async" | "unsafe" | "extern" STR?)* fn | "struct" ID gens? where? ({: fields? :} | ((: tfields? :))? where? ";")
 | "enum" ID gens? where? {: (variant ("," variant)* ","?)? :} | "union" ID {: fields? :} | "type" ID gens? ("=" type)? ";" | "unsafe"? "trait" ID gens? (":" bounds)? where? {: assoc :}
 | "unsafe"? "impl" gens? ("!"? type "for")? type where? {: assoc :} | ("const" | "static") "mut"? ID (":" type)? ("=" expr)? ";" | "extern" "crate" ID ("as" ID)? ";" | "extern" STR? {: assoc :}
usetree = useseg ("::" useseg)* ("as" ID)?
useseg = ID | "self" | "super" | "crate" | "*" | {: (usetree ("," usetree)* ","?)? :}
fn = "fn" ID gens? (: (param ("," param)* ","?)? :) ("->" type)? where? ({: block :} | ";")
param = attr* (pat (":" type)? | "&" LIFE? "mut"? "self" | "mut"? "self" (":" type)? | "..." )
gens = "<" (gen ("," gen)* ","?)? ">"
gen = LIFE (":" LIFE ("+" LIFE)*)? | "const"? ID (":" bounds)? ("=" type0)?
bounds = (bound ("+" bound)*)?
bound = LIFE | "?"? path0 | (: bound :)
where = "where" (type ":" bounds ("," type ":" bounds)* ","?)?
fields = attr* vis? ID ":" type ("," attr* vis? ID ":" type)* ","?
tfields = attr* vis? type ("," attr* vis? type)* ","?
variant = attr* ID ({: fields? :} | (: tfields? :))? ("=" expr)?
assoc = (attr* vis? "default"? (("const" | "async" | "unsafe" | "extern" STR?)* fn | "type" ID gens? (":" bounds)? ("=" type)? ";" | "const" ID ":" type ("=" expr)? ";" | ID "!" (: margs :) ";"))*
path = ("::")? seg ("::" seg)*
seg = ID | "self" | "super" | "crate"
type = type1
type0 = tpre* tatom ("+" (LIFE | path))*
tpre = "&" LIFE? "mut"? | "&&" | "*" ("const" | "mut") | "dyn" | "impl" | "for" "<" LIFE ">" | "?"
tatom = path | "!" | (: (type ("," type)* ","?)? :) ("->" path)? | [: type (";" expr)? :] | "unsafe"? ("extern" STR?)? "fn" (: (type ("," type)* ","?)? :) ("->" path)? | path (: (type ("," type)*)? :) ("->" tpre* tatom1)?
tatom1 = path | (: (type ("," type)*)? :) | [: type :]
targ0 = LIFE | NUM | (ID "=")? tpre* tatom | {: expr :}
path0 = path "::"? ("<" (targ0 ("," targ0)*)? ">" )? ("::" ID)* | path (: (type ("," type)*)? :) ("->" tpre* tatom1)?
targ1 = LIFE | NUM | (ID "=")? tpre* (tatom | path0) ("+" (LIFE | path))* | {: expr :}
path1 = path ("::"? "<" (targ1 ("," targ1)* ","?)? ">"+ ("::" ID)?)* | "<" tpre* path0 ("as" path0)? ">" ("::" ID)+
type1 = tpre* (tatom | path1) ("+" (LIFE | path0))*
pat = "|"? (patun ((BOP | "|") patun)*)
patun = ("&" | "&&" | "mut" | "ref" | "-")* (path ({: (patf ("," patf)* ","?)? :} | (: pats? :))? | NUM | STR | CHR | (: pats? :) | [: pats? :] | "..") ((".." ) ("-"? (NUM | CHR | path))?)? ("@" patun1)?
patun1 = ("&" | "-")* (path (: pats? :)? | NUM | CHR | (: pats? :) | [: pats? :]) (".." "-"? (NUM | CHR | path)?)?
pats = pat ("," pat)* ","?
patf = "ref"? "mut"? ID (":" pat)? | ".."
block = inner* (attr* stmt)* expr?
stmt = "let" pat (":" type)? ("=" expr)? ("else" {: block :})? ";" | vis? item | expr ";" | blocky | ";"
blocky = (LIFE ":")? ("unsafe" | "async" "move"?)? {: block :} | (LIFE ":")? "loop" {: block :} | (LIFE ":")? "while" cond {: block :} | (LIFE ":")? "for" pat "in" expr {: block :} | iff | "match" expr {: arms :} | path "!" {: mbody :}
cond = ("let" pat "=" expr | expr) (BOP ("let" pat "=" un | un))*
iff = "if" cond {: block :} ("else" "if" cond {: block :})* ("else" {: block :})?
arms = (attr* pat ("if" cond)? "=>" (expr ","? | expr "," ))*
expr = range (("=" | AOP) range)*
range = bin? (".." bin?)? | bin
bin = un ((PM | "+" | "-" | "*" | "&" | "&&" | BOP | "|" | "||" | "<" | ">" | "<" "<" | ">" ">") un | "as" type)*
jump = "return" | "break" LIFE? | "continue" LIFE? | "move"
un = ("-" | "!" | "*" | "&" "mut"? | "&&" "mut"? | "return" | "break" LIFE? | "move" | "async" | closure)* atom post*
closure = "|" (cparam ("," cparam)* ","?)? "|" ("->" type)? | "||"
cparam = patun (":" type)?
atom = path1 ({: (finit ("," finit)* ("," ".." expr)? ","? | ".." expr)? :})? | NUM | STR | CHR | (: (expr ("," expr)* ","?)? :) | [: (expr ("," expr)* ","? | expr ";" expr)? :] | jump | path "!" ((: margs :) | [: margs :] | {: mbody :}) | blockexpr
blockexpr = (LIFE ":")? ("unsafe" | "async")? {: block :} | (LIFE ":")? "loop" {: block :} | "match" expr1 {: arms :} | "if" expr1 {: block :} ("else" "if" expr1 {: block :})* ("else" {: block :})? | (LIFE ":")? "while" expr1 {: block :} | (LIFE ":")? "for" pat "in" expr1 {: block :}
expr1 = ("let" pat "=")? un1 ((PM | "+" | "-" | "*" | "&" | "&&" | BOP | "|" | "||" | "<" | ">" | "..") un1)*
un1 = ("-" | "!" | "*" | "&" "mut"? )* (path1 | NUM | STR | CHR | (: (expr ("," expr)* ","?)? :) | [: (expr ("," expr)* ","?)? :] | path "!" (: margs :)) post*
post = "?" | "." (ID | NUM | "await") ("::" "<" (targ1 ("," targ1)*)? ">"+)? | (: (expr ("," expr)* ","?)? :) | [: expr :]
finit = ID (":" expr)?
margs = (marg (("," | ";" | "=>") marg)* ("," | ";")?)?
marg = (ID "=")? expr | type | pat ("if" cond)?
mbody = (attr* vis? item | stmt | (: any :) "=>" {: any :} ";"?)* expr?
any = ("$" ID ":" ID | "$" (: any :) ("," | ";")? ("*" | "+" | "?") | expr | stmt | ",")*
"""

TYPESCRIPT = r"""
file = stmts
stmts = (stmt | dec* item)*
item = ("export" "default"? | "declare")? mod* (fun | cls | itf | ali | enu | vardecl ";" | "namespace" ID ("." ID)* {: stmts :}) | "export" ("default" expr ";" | "*" ("as" ID)? "from" STR ";" | "type"? {: (spec ("," spec)* ","?)? :} ("from" STR)? ";" | "=" expr ";")
 | "import" ("type"? (ID | "*" "as" ID | {: (spec ("," spec)* ","?)? :} | ID "," ({: (spec ("," spec)* ","?)? :} | "*" "as" ID)) "from" STR | STR | ID "=" expr) ";"
mod = "async" | "abstract" | "declare"
spec = "type"? (word | STR | "default") ("as" (word | STR | "default"))?
word = ID | "of" | "async" | "type" | "static" | "as" | "satisfies" | "from" | "keyof" | "readonly" | "infer" | "unique" | "is" | "asserts" | "public" | "private" | "protected" | "get" | "set" | "override" | "abstract" | "declare" | "accessor" | "namespace" | "implements" | "interface" | "let" | "yield" | "await"
dec = "@" ID ("." ID)* ((: args? :))?
fun = "async"? "function" "*"? ID? tpar? (: params :) (":" type)? ({: stmts :} | ";")
cls = "class" ID? tpar? ("extends" post1 targs?)? ("implements" type ("," type)*)? {: members :}
post1 = (ID | (: expr :)) ("." ID | (: args? :))*
itf = "interface" ID tpar? ("extends" type ("," type)*)? {: tmembers :}
ali = "type" ID tpar? "=" "|"? type ";"
enu = "const"? "enum" ID {: (ID ("=" tern)? ("," ID ("=" tern)?)* ","?)? :}
members = (dec | ";" | "static" {: stmts :} | cmod* key ("?" | "!")? ((: params :) (":" type)? ({: stmts :} | ";") | tpar (: params :) (":" type)? ({: stmts :} | ";") | (":" type)? ("=" expr)? ";") | cmod* [: ID ":" type :] ":" type ";")*
cmod = "static" | "async" | "*" | "public" | "private" | "protected" | "readonly" | "get" | "set" | "override" | "abstract" | "declare" | "accessor"
key = word | kw | STR | NUM | [: expr :]
kw = "catch" | "delete" | "default" | "finally" | "for" | "of" | "return" | "throw" | "with" | "new" | "import" | "export" | "if" | "in" | "continue" | "break" | "switch" | "case" | "typeof" | "void" | "do"
tpar = "<" ("const"? ID ("extends" type)? ("=" type)? ("," ID ("extends" type)? ("=" type)?)* ","?) ">"
targs = "<" type ("," type)* ">"+
type = ("asserts"? (ID | "this") "is")? type2 ("extends" type2 "?" type2 ":" type2)*
type2 = "|"? tun ((BOP | "|" | "&") tun)*
tun = ("typeof" | "keyof" | "readonly" | "infer" | "unique" | "abstract" | "new" | (: params :) "=>" | tpar0 (: params :) "=>")* tprim ([: type? :])*
tpar0 = "<" ID ("," ID)* ">"
tprim = word ("." ID)* (targs0)? | "void" | "this" | STR | NUM | PM NUM | "import" (: STR :) ("." ID)* | {: tmembers :} | [: (tel ("," tel)* ","?)? :] | (: type :)
tel = "..."? (ID "?"? ":")? type "?"?
targs0 = "<" targ ("," targ)* ">"*
targ = targ1 ((BOP | "|" | "&") targ1)*
targ1 = ("typeof" | "keyof" | "readonly" | "infer" | (: params :) "=>")* (ID ("." ID)* ("<" ID ("." ID)* (("," | BOP | "|") ID)* ("<" ID ("," ID)* ">"*)? ">"*)? | "void" | STR | NUM | {: tmembers :} | [: (tel ("," tel)*)? :] | (: type :)) ([: type? :])*
tmembers = (tmember (";" | ",")?)*
tmember = ("readonly" | "get" | "set" | PM "readonly")? (key | [: ID (":" type | "in" type ("as" type)?) :])? ("?" | "-" "?" | PM "?")? ((: params :))? (":" type)? | tpar (: params :) (":" type)? | "new" (: params :) ":" type
params = (param ("," param)* ","?)?
param = dec* ("public" | "private" | "protected" | "readonly" | "override")* "..."? (bind | "this") "?"? (":" type)? ("=" expr)?
bind = word | {: (bprop ("," bprop)* ","?)? :} | [: (bel? ("," bel?)*) :]
bprop = (key ":" bind | word) ("=" expr)? | "..." ID
bel = "..."? bind ("=" expr)?
vardecl = ("const" | "let" | "var") bdecl ("," bdecl)*
bdecl = bind "!"? (":" type)? ("=" expr)?
expr = tern (("=" | AOP) tern)*
exprs = expr ("," expr)*
tern = bin ("?" expr ":" bin (("=" | AOP) bin)*)*
bin = un ((PM | "*" | "&" | "|" | BOP | "<" | ">" | ">" ">"+ | "in" | "instanceof") un | ("as" | "satisfies") (type2 | "const"))*
arrow = "async"? (word | tpar? (: params :) (":" type2)?) "=>"
un = (PM | "!" | "~" | INC | "typeof" | "void" | "delete" | "await" | "yield" "*"? | "new" | arrow)* prim post*
prim = word | NUM | STR | "this" | "super" | "import" | (: exprs :) | [: (","* el (","+ el)* ","*)? :] | {: objs :} | fun1 | cls | "new" "." ID
fun1 = "async"? "function" "*"? ID? tpar? (: params :) (":" type)? {: stmts :}
el = "..."? expr
objs = (obj ("," obj)* ","?)? | stmts
obj = "..." expr | ("get" | "set" | "async" | "*")* key ((: params :) (":" type)? {: stmts :} | ":" expr)? | ID "=" expr
args = ("..."? expr) ("," "..."? expr)* ","?
post = "." ID | "?." (ID | (: args? :) | [: exprs :]) | (: args? :) | [: exprs :] | INC | STR | "!" | targs (: args? :)
head = "if" (: exprs :) | "while" (: exprs :) | "for" "await"? (: forin :) | "with" (: exprs :) | "do" | ID ":"
forin = (vardecl | exprs)? ";" exprs? ";" exprs? | ("const" | "let" | "var")? (bind | expr) ("of" | "in") exprs
body = {: stmts :} | simple | "try" {: stmts :} ("catch" ((: bind (":" type)? :))? {: stmts :})? ("finally" {: stmts :})? | "switch" (: exprs :) {: cases :}
cases = (("case" exprs | "default") ":" stmts)*
stmt = head* body (";"? "else" head* body)*
simple = vardecl ";" | exprs? ";" | "return" exprs? ";" | "break" ID? ";" | "continue" ID? ";" | "throw" exprs ";" | "debugger" ";" | vardecl | exprs | "return" exprs?
"""

SOURCES = {"python": PYTHON, "c": C, "cpp": CPP, "go": GO, "java": JAVA, "rust": RUST, "typescript": TYPESCRIPT}
_TOKEN = re.compile(r'"[^"]*"|\(:|:\)|\[:|:\]|\{:|:\}|<:|:>|[A-Za-z_]\w*|[()|*+?=]')


def _parse(source: str) -> dict[str, tuple]:
    """Rules as trees: (term, t), (ref, name), (seq, [..]), (alt, [..]), (rep, x, least, most), (group, opener, x)."""
    joined: list[str] = []
    for line in source.strip().splitlines():
        if re.match(r"\w+ = ", line):
            joined.append(line)
        else:
            joined[-1] += " " + line
    rules: dict[str, tuple] = {}
    names = {x.split(" = ")[0] for x in joined}
    for line in joined:
        name, text = line.split(" = ", 1)
        tokens, at = _TOKEN.findall(text), 0

        def alt() -> tuple:
            nonlocal at
            options = [seq()]
            while at < len(tokens) and tokens[at] == "|":
                at += 1
                options.append(seq())
            return options[0] if len(options) == 1 else ("alt", options)

        def seq() -> tuple:
            nonlocal at
            parts = []
            while at < len(tokens) and tokens[at] not in ("|", ")") and tokens[at] not in CLOSE:
                t = tokens[at]
                at += 1
                if t == "(":
                    x = alt()
                    at += 1
                elif t in OPEN:
                    x = ("group", OPEN[t], alt())
                    at += 1
                elif t[0] == '"':
                    x = ("term", t[1:-1])
                elif t in names:
                    x = ("ref", t)
                else:
                    x = ("term", t)
                while at < len(tokens) and tokens[at] in "*+?":
                    x = ("rep", x, 1 if tokens[at] == "+" else 0, 1 if tokens[at] == "?" else None)
                    at += 1
                parts.append(x)
            return parts[0] if len(parts) == 1 else ("seq", parts)

        rules[name] = alt()
    return rules


class Grammar:
    """What is derived from a grammar.

    chars: terminal -> the character that stands for it. pairs: permissible neighbours, with ^ for the begin and $ for the end of a file.
    levels: (terminal before, opener) -> the contents that may stand there, for fits().
    """

    def __init__(self, lang: str):
        self.rules = _parse(SOURCES[lang])
        self.groups: list[tuple[str, tuple]] = []
        self._seen: dict[str, tuple] = {}
        self.rules = {k: self._number(v) for k, v in self.rules.items()}
        terms = {"^", "$", "BAD", "(", ")", "[", "]", "{", "}", "INDENT", "DEDENT"}
        self._terms(terms)
        from .lexing import KEYWORDS, _CLASS, _CLASS_C

        terms |= KEYWORDS[lang] | set(_CLASS[lang].values()) | set(_CLASS_C) | set(_CLASS[lang]) | {"ID", "NUM", "STR", "CHR", "CONST", "LIFE", "NL", "AOP", "BOP", "PM", "INC"} | set("~?:;,.@#$!<>=*&|\\") | {"->", "=>", "::", "..", "...", "?.", "<-", ":=", "&&", "||", "->*"}
        self.chars = {t: chr(0x100 + i) for i, t in enumerate(sorted(terms))}
        self._derive_pairs()
        self._derive_levels()

    def _number(self, x: tuple) -> tuple:
        if x[0] == "group":
            self.groups.append((x[1], None))
            i = len(self.groups) - 1
            inner = self._number(x[2])
            self.groups[i] = (x[1], inner)
            return ("group", x[1], i)
        if x[0] in ("seq", "alt"):
            return (x[0], [self._number(y) for y in x[1]])
        if x[0] == "rep":
            return ("rep", self._number(x[1]), x[2], x[3])
        return x

    def _terms(self, out: set[str]) -> None:
        def walk(x: tuple) -> None:
            if x[0] == "term":
                out.add(x[1])
            elif x[0] in ("seq", "alt"):
                for y in x[1]:
                    walk(y)
            elif x[0] == "rep":
                walk(x[1])

        for x in [*self.rules.values(), *(g for _, g in self.groups)]:
            walk(x)

    def _derive_pairs(self) -> None:
        empty: dict[str, bool] = dict.fromkeys(self.rules, False)
        first: dict[str, set] = {k: set() for k in self.rules}
        last: dict[str, set] = {k: set() for k in self.rules}

        def of(x: tuple) -> tuple[bool, set, set]:
            if x[0] == "term":
                return False, {x[1]}, {x[1]}
            if x[0] == "ref":
                return empty[x[1]], first[x[1]], last[x[1]]
            if x[0] == "group":
                return False, {(x[1], x[2])}, {PARTNER[x[1]]}
            if x[0] == "rep":
                e, f, l = of(x[1])
                return e or not x[2], f, l
            if x[0] == "alt":
                each = [of(y) for y in x[1]]
                return any(e for e, _, _ in each), set().union(*(f for _, f, _ in each)), set().union(*(l for _, _, l in each))
            e, f, l = True, set(), set()
            for y in x[1]:
                a, b, c = of(y)
                if e:
                    f = f | b
                l = (l | c) if a else c
                e = e and a
            return e, f, l

        changed = True
        while changed:
            changed = False
            for k, x in self.rules.items():
                e, f, l = of(x)
                if e != empty[k] or not f <= first[k] or not l <= last[k]:
                    empty[k], first[k], last[k] = e, first[k] | f, last[k] | l
                    changed = True
        raw: set[tuple] = set()

        def cross(a: set, b: set) -> None:
            raw.update((p, q) for p in a for q in b)

        def walk(x: tuple) -> None:
            if x[0] == "rep":
                walk(x[1])
                if x[3] is None:
                    _, f, l = of(x[1])
                    cross(l, f)
            elif x[0] == "alt":
                for y in x[1]:
                    walk(y)
            elif x[0] == "seq":
                before: set = set()
                for y in x[1]:
                    walk(y)
                    e, f, l = of(y)
                    cross(before, f)
                    before = (before | l) if e else l
                    
        for x in self.rules.values():
            walk(x)
        for opener, x in self.groups:
            walk(x)
            e, f, l = of(x)
            cross({opener}, f)
            cross(l, {PARTNER[opener]})
            if e:
                raw.add((opener, PARTNER[opener]))
        e, f, l = of(self.rules["file"])
        cross({"^"}, f)
        cross(l, {"$"})
        if e:
            raw.add(("^", "$"))
        name = lambda t: t[0] if isinstance(t, tuple) else t
        self.pairs = {(p, name(q)) for p, q in raw}
        self._context: dict[tuple[str, str], set[int]] = {}
        for p, q in raw:
            if isinstance(q, tuple):
                self._context.setdefault((p, q[0]), set()).add(q[1])

    def _derive_levels(self) -> None:
        """Small automata of the rules and of the brackets' contents; a rule is entered by a call with a place to return to."""
        self._moves: list[dict[str, list[int]]] = []
        self._free: list[list[int]] = []
        self._calls: list[list[tuple[str, int]]] = []
        self._ends: set[int] = set()
        self._entry: dict[str | int, int] = {}

        def state() -> int:
            self._moves.append({})
            self._free.append([])
            self._calls.append([])
            return len(self._moves) - 1

        def build(x: tuple, a: int) -> int:
            if x[0] == "seq":
                for y in x[1]:
                    a = build(y, a)
                return a
            z = state()
            if x[0] in ("term", "group"):
                self._moves[a].setdefault(self.chars[x[1]], []).append(z)
            elif x[0] == "ref":
                self._calls[a].append((x[1], z))
            elif x[0] == "alt":
                for y in x[1]:
                    m = state()
                    self._free[a].append(m)
                    self._free[build(y, m)].append(z)
            else:
                m = state()
                self._free[a].append(m)
                e = build(x[1], m)
                self._free[e].append(z)
                if x[3] is None:
                    self._free[e].append(m)
                if not x[2]:
                    self._free[a].append(z)
            return z

        for k, x in [*self.rules.items(), *((i, x) for i, (_, x) in enumerate(self.groups))]:
            self._entry[k] = state()
            self._ends.add(build(x, self._entry[k]))
        self.levels = {key: tuple(sorted(ids)) for key, ids in self._context.items()}
        self._sets: dict[frozenset, int] = {}
        self._content: list[frozenset] = []
        self._accepts: list[bool] = []
        self._step: list[dict[str, int]] = []
        self._start: dict[tuple, int] = {}

    def _known(self, places: list[tuple]) -> int:
        """The deterministic state of these places (state, stack of returns) and of all that need no terminal from there."""
        seen, work, accepts = set(places), list(places), False
        while work:
            at, stack = work.pop()
            more = [(z, stack) for z in self._free[at]]
            if stack is None or stack[2] < DEEPEST:
                more += [(self._entry[rule], (z, stack, stack[2] + 1 if stack else 1)) for rule, z in self._calls[at]]
            if at in self._ends:
                if stack is None:
                    accepts = True
                else:
                    more.append((stack[0], stack[1]))
            for m in more:
                if m not in seen:
                    seen.add(m)
                    work.append(m)
        key = frozenset(x for x in seen if self._moves[x[0]])
        i = self._sets.get((key, accepts))
        if i is None:
            i = self._sets[key, accepts] = len(self._content)
            self._content.append(key)
            self._accepts.append(accepts)
            self._step.append({})
        return i

    def fits(self, rule: tuple | None, content: str) -> bool:
        """Whether the content (terminals as chars) is what the rule asks for; rule: a value of levels, None for a whole file."""
        s = self._start.get(rule)
        if s is None:
            s = self._start[rule] = self._known([(self._entry[k], None) for k in (rule or ("file",))])
        for c in content:
            z = self._step[s].get(c)
            if z is None:
                z = self._step[s][c] = self._known([(t, stack) for at, stack in self._content[s] for t in self._moves[at].get(c, ())])
            s = z
            if not self._content[s] and not self._accepts[s]:
                return False
        return self._accepts[s]

    def level(self, before: str, opener: str) -> tuple | None:
        """The contents a bracket may have, by the chars of the terminal before it and its own; None where it must not stand."""
        if not hasattr(self, "_names"):
            self._names = {v: k for k, v in self.chars.items()}
        return self.levels.get((self._names[before], self._names[opener]))

    def text(self, terminals: list[str]) -> str:
        return "".join(self.chars.get(t, self.chars["BAD"]) for t in terminals)


@lru_cache(maxsize=None)
def grammar(lang: str) -> Grammar:
    return Grammar(lang)


def faults(lang: str, terminals: list[str]) -> list[str]:
    """The same tests as the operator's, one file at a time in plain Python: for tests and for looking at a file."""
    g = grammar(lang)
    out = [f"pair {p} {q}" for p, q in zip(["^", *terminals], [*terminals, "$"]) if (p, q) not in g.pairs]
    content: list[list[str]] = [[]]
    stack: list[tuple[int, str, int]] = []
    rule: list = [None]
    close = {v: k for k, v in PARTNER.items()}
    before = "^"
    for t in terminals:
        if t in PARTNER:
            content[stack[-1][0] if stack else 0].append(t)
            content.append([])
            rule.append(g.levels.get((before, t), ()))
            stack.append((len(content) - 1, t, 0))
        elif t in close:
            if not stack or stack[-1][1] != close[t]:
                return [*out, f"nesting {t}"]
            stack.pop()
        else:
            content[stack[-1][0] if stack else 0].append(t)
        before = t
    if stack:
        out.append(f"open {stack[-1][1]}")
        return out
    for c, r in zip(content, rule):
        if r != () and not g.fits(r, g.text(c)):
            out.append("production " + " ".join(c))
    return out
