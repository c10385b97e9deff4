"""Grammars of the languages, in the notation of ``chart``. Precedence is left out, as it doesn't decide whether a file parses."""

from __future__ import annotations

PYTHON_WORDS = set("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())

PYTHON = r"""
file = NL* (stmt NL*)* EOF
@stmt = compound | simple
simple = small (';' small)* ';'? NL
small = 'pass' | 'break' | 'continue' | 'del' targets | 'return' stars? | 'raise' (expr ('from' expr)?)? | 'global' NAME % ',' | 'nonlocal' NAME % ',' | 'import' (dotted ('as' NAME)?) % ',' | 'from' fromwhere 'import' fromwhat | 'assert' expr (',' expr)? | 'type' NAME tparams? '=' expr | exprstmt
dotted = NAME ('.' NAME)*
fromwhere = ('.' | '...')* dotted | ('.' | '...') ('.' | '...')*
fromwhat = '*' | '(' alias (',' alias)* ','? ')' | alias % ','
alias = NAME ('as' NAME)?
exprstmt = assignable '=' assigned | tprim ':' expr ('=' (yieldx | stars))? | tprim AUG (yieldx | stars) | yieldx | stars !'=' !':' !AUG
assigned = assignable '=' assigned | yieldx | stars
assignable = target (',' target)* ','? &'='
target = '*'? tprim
@tprim = atom (trailer &tstart)* ('.' NAME | '[' subs ']') | NAME | '(' targets? ')' | '[' targets? ']'
tstart = '.' | '[' | '('
compound = 'if' named ':' block elifs | 'while' named ':' block elseb? | 'async'? 'for' targets 'in' stars ':' block elseb? | 'try' ':' block trytail | 'async'? 'with' withitems ':' block | decorator* (funcdef | classdef) | matchst
elifs = ('elif' named ':' block)* elseb?
elseb = 'else' ':' block
trytail = ('except' '*'? (stars ('as' NAME)?)? ':' block)+ elseb? ('finally' ':' block)? | 'finally' ':' block
withitems = '(' (expr ('as' target)?) % ',' ','? ')' &':' | (expr ('as' target)?) % ','
decorator = '@' named NL
funcdef = 'async'? 'def' NAME tparams? '(' params? ')' ('->' expr)? ':' block
classdef = 'class' NAME tparams? ('(' args? ')')? ':' block
tparams = '[' (('*' | '**')? NAME (':' expr)? ('=' expr)?) % ',' ','? ']'
block = NL IND NL* (stmt NL*)+ DED | simple
matchst = 'match' stars ':' NL IND ('case' patterns ('if' named)? ':' block NL*)+ DED
patterns = pat (',' pat)* ','?
pat = '*'? expr ('as' NAME)?
params = param % ',' ','?
param = '**' NAME (':' expr)? | '*' (NAME (':' ('*'? expr))?)? | '/' | NAME (':' expr)? ('=' expr)?
lparams = lparam % ',' ','?
lparam = '**' NAME | '*' NAME? | '/' | NAME ('=' expr)?
targets = ('*'? tprim) % ',' ','?
stars = ('*'? named) % ',' ','?
yieldx = 'yield' ('from' expr | stars)?
named = NAME ':=' expr | expr
@expr = 'lambda' lparams? ':' expr | orx ('if' orx 'else' expr)?
@orx = unit (binop unit)*
unit = ('not' | '-' | '+' | '~')* primary
binop = 'or' | 'and' | 'in' | 'not' 'in' | 'is' 'not'? | OP | '*' | '**' | '-' | '+' | '/' | '@'
@primary = 'await'? atom trailer*
trailer = '.' NAME | '(' args? ')' | '[' subs ']'
str = STR | FHEAD (FOPEN (yieldx | stars) '='? FCLOSE)* FTAIL
atom = NAME | NUM | str str* | '...' | 'None' | 'True' | 'False' | '(' (yieldx | comp | stars)? ')' | '[' (comp | stars)? ']' | '{' (dict | comp | stars)? '}'
comp = named compfor
compfor = ('async'? 'for' targets 'in' orx ('if' cond)*)+
cond = NAME ':=' orx | 'lambda' lparams? ':' expr | orx
dict = expr ':' expr compfor | pair % ',' ','?
pair = '**' orx | expr ':' expr
args = arg % ',' ','?
arg = '**' expr | '*' expr | NAME '=' expr | named compfor?
subs = sub % ',' ','?
sub = '*' orx | expr? ':' expr? (':' expr?)? | named
"""

JS_WORDS = set("break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split())

_SCRIPT = r"""
file = HASHBANG? stmt* EOF
@stmt = block | ';' | vardecl EOS | decorators? 'abstract'? classx | decorators &'export' exportst | 'async'? 'function' '*'? NAME fnrest | ifst | forst | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';'? | 'return' (NONL expr)? EOS | 'break' (NONL NAME)? EOS | 'continue' (NONL NAME)? EOS | 'throw' NONL expr EOS | tryst | switchst | importst | exportst | 'debugger' EOS | NAME ':' stmt | tsstmt | !'function' !'class' !'{' expr EOS
block = '{' stmt* '}'
vardecl = ('var' | 'let' | 'const' !'enum' | 'using' NONL) declr % ','
declr = bind '!'? annot? ('=' assign)?
bind = NAME | '[' (bindel? ',')* bindel? ']' | '{' bindprops? '}'
bindel = '...'? bind ('=' assign)?
bindprops = bindprop (',' bindprop)* ','?
bindprop = '...' bind | propname ':' bind ('=' assign)? | NAME ('=' assign)?
ifst = 'if' '(' expr ')' stmt ('else' stmt)?
forst = 'for' 'await'? '(' forhead ')' stmt
forhead = ('var' | 'let' | 'const') bind annot? ('of' assign | 'in' expr) | unary ('of' assign | 'in' expr) | (vardecl | expr)? ';' expr? ';' expr?
tryst = 'try' block ('catch' ('(' bind annot? ')')? block)? ('finally' block)?
switchst = 'switch' '(' expr ')' '{' ('case' expr ':' stmt* | 'default' ':' stmt*)* '}'
importst = 'import' !'(' !'.' (STR | 'type'? importwhat 'from' STR | NAME '=' 'require' '(' STR ')' | NAME '=' qname) importattrs? EOS
importattrs = ('with' | 'assert') objlit
importwhat = NAME (',' (names | '*' 'as' NAME))? | names | '*' 'as' NAME
names = '{' (nameas (',' nameas)* ','?)? '}'
nameas = 'type'? (idname | STR) ('as' (idname | STR))?
exportst = 'export' ('*' ('as' (idname | STR))? 'from' STR importattrs? EOS | 'type'? names ('from' STR importattrs?)? EOS | 'default' exportdef | '=' expr EOS | 'as' 'namespace' NAME EOS | decorators? 'abstract'? classx | vardecl EOS | 'async'? 'function' '*'? NAME fnrest | tsstmt)
exportdef = decorators? 'abstract'? 'class' NAME? classrest | 'async'? 'function' '*'? NAME? fnrest | tsiface | assign EOS
decorators = ('@' (NAME ('.' idname)* targs? arglist? | '(' expr ')'))+
classx = 'class' NAME classrest
classrest = tparams? ('extends' unary targs?)? implements? '{' member* '}'
member = ';' | 'static' block | decorators? mods memberbody
mods = (modifier &memberstart)*
modifier = 'static' | 'async' | 'get' | 'set' | 'accessor' | tsmod
memberstart = NAME | KEYWORD | STR | NUM | '[' | '*' | PRIVATE
memberbody = indexsig EOS | '*'? propname '?'? tparams? '(' params? ')' rettype? (block | tsabstract EOS) | propname ('?' | '!')? annot? ('=' assign)? EOS
propname = idname | STR | NUM | '[' assign ']' | PRIVATE
idname = NAME | KEYWORD
fnrest = tparams? '(' params? ')' rettype? (block | tsabstract EOS)
params = param (',' param)* ','?
param = decorators? (tsmod &NAME)* '...'? ('this' | bind) '?'? annot? ('=' assign)?
@expr = assign % ','
@assign = arrow | yieldx | unary binary* ('?' assign ':' assign)? (ASSIGN assign | '=' assign)?
yieldx = 'yield' (NONL '*'? assign)?
arrow = ('async' NONL)? (NAME | tparams? '(' params? ')' rettype?) NONL '=>' (block | !'{' assign)
binary = BINOP unary | '<' unary | '>' ('>' '>'?)? '='? unary | ('*' | '+' | '-' | '|' | '&' | 'in' | 'instanceof') unary | '/' unary | tsas
unary = ('!' | '~' | '+' | '-' | INC | 'typeof' | 'void' | 'delete' | 'await' | tscast)* postfix
@postfix = primary trailer* (NONL INC)?
trailer = '.' (idname | PRIVATE) | '?.' (idname | PRIVATE | '[' expr ']' | targs? arglist | template) | '[' expr ']' | arglist | template | tsnonnull | targs &calls
calls = '(' | template | ')' | ',' | ';' | ']' | '.' | '}' | EOF
arglist = '(' (('...'? assign) % ',' ','?)? ')'
primary = 'this' | 'super' | NUM | STR | REGEX | template | 'null' | 'true' | 'false' | PRIVATE | arraylit | objlit | 'async' NONL 'function' '*'? NAME? fnrest | 'function' '*'? NAME? fnrest | decorators? 'class' (NAME !(!'extends' !'implements' !'{' !'<' NAME))? classrest | 'new' ('.' NAME | newexpr) | '(' expr ')' | 'import' ('(' assign (',' assign)? ','? ')' | '.' idname) | NAME
newexpr = 'new' newexpr | primary (('.' (idname | PRIVATE)) | '[' expr ']' | targs &'(')* arglist?
arraylit = '[' (('...'? assign)? ',')* ('...'? assign)? ']'
objlit = '{' (objprop (',' objprop)* ','?)? '}'
objprop = '...' assign | ('get' | 'set') propname '(' params? ')' rettype? block | 'async'? '*'? propname tparams? '(' params? ')' rettype? block | propname ':' assign | NAME ('=' assign)?
template = TPL | THEAD expr (TMID expr)* TTAIL
"""

JAVASCRIPT = _SCRIPT + r"""
annot = NEVER
rettype = NEVER
tparams = NEVER
targs = NEVER
implements = NEVER
tsstmt = NEVER
tsiface = NEVER
tsmod = NEVER
tsabstract = NEVER
indexsig = NEVER
tsas = NEVER
tscast = NEVER
tsnonnull = NEVER
qname = NEVER
"""

TYPESCRIPT = _SCRIPT + r"""
annot = ':' type
rettype = ':' type
implements = 'implements' typeref % ','
tsstmt = tsiface | 'type' NAME tparams? '=' type EOS | 'const'? 'enum' NAME enumbody | 'declare' NONL declared | ('namespace' | 'module') NONL (NAME ('.' NAME)* | STR) block
tsiface = 'interface' NAME tparams? ('extends' typeref % ',')? objtype
declared = tsstmt | vardecl EOS | 'async'? 'function' '*'? NAME fnrest | 'abstract'? classx | 'global' block | 'module' STR (block | EOS)
enumbody = '{' (enumel (',' enumel)* ','?)? '}'
enumel = (idname | STR) ('=' assign)?
tsmod = 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'override' | 'declare'
tsabstract = !'{'
indexsig = 'readonly'? '[' NAME ':' type ']' annot
tsas = NONL ('as' ('const' | type) | 'satisfies' type)
tscast = '<' type '>'
tsnonnull = NONL '!'
typeref = qname targs?
qname = NAME ('.' idname)*
tparams = '<' (('const' | 'in' | 'out')* NAME ('extends' type)? ('=' type)?) % ',' ','? '>'
@targs = '<' type % ',' ','? '>'
@type = 'abstract'? 'new'? tparams? '(' params? ')' '=>' type | condtype
condtype = union (NONL 'extends' union '?' type ':' type)?
union = '|'? inter ('|' inter)*
inter = '&'? pretype ('&' pretype)*
pretype = ('keyof' | 'unique' | 'readonly') pretype | 'infer' NAME ('extends' pretype)? | 'asserts' (NAME | 'this') ('is' type)? | (NAME | 'this') NONL 'is' type | postype
postype = ptype (NONL '[' type? ']')*
ptype = '(' type ')' | objtype | '[' (tupel (',' tupel)* ','?)? ']' | STR | '-'? NUM | ttemplate | 'typeof' ('import' '(' STR ')' ('.' idname)* | qname) targs? | 'import' '(' STR ')' ('.' idname)* targs? | 'this' | 'void' | 'null' | 'true' | 'false' | qname (NONL targs)?
tupel = '...'? (NAME '?'? ':' type | type '?'?)
ttemplate = TPL | THEAD type (TMID type)* TTAIL
objtype = '{' mapped '}' | '{' (typemember typesep)* typemember? '}'
typesep = ';' | ',' | EOS
mapped = (('+' | '-')? 'readonly')? '[' NAME 'in' type ('as' type)? ']' (('+' | '-')? '?')? (':' type)? ';'?
typemember = 'readonly'? '[' NAME ':' type ']' ':' type | 'new'? tparams? '(' params? ')' rettype? | ('get' | 'set') propname '(' params? ')' rettype? | ('readonly' &memberstart)? propname '?'? (tparams? '(' params? ')' rettype? | annot)?
"""

JAVA_WORDS = set("abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null _".split())

JAVA = r"""
file = (annots? 'package' qname ';')? (import | ';')* (typedecl | ';' | member)* EOF
import = 'import' 'static'? NAME ('.' NAME)* ('.' '*')? ';'
qname = NAME ('.' NAME)*
annots = annot annot*
annot = '@' !'interface' qname ('(' (annarg % ',' | )? ')')?
annarg = NAME '=' annval | annval
annval = annot | '{' (annval (',' annval)* ','?)? ','? '}' | ternary
mods = (annot | 'public' | 'private' | 'protected' | 'static' | 'abstract' | 'final' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' !':' !'->' | 'sealed' &modnext | 'non' '-' 'sealed')*
modnext = 'class' | 'interface' | 'abstract' | 'public' | 'private' | 'protected' | 'static' | 'strictfp'
@typedecl = mods ('class' NAME tparams? ('extends' type)? ('implements' types)? ('permits' types)? classbody | 'interface' NAME tparams? ('extends' types)? ('permits' types)? classbody | 'enum' NAME ('implements' types)? enumbody | 'record' NAME tparams? '(' params? ')' ('implements' types)? classbody | '@' 'interface' NAME classbody)
types = type % ','
classbody = '{' member* '}'
enumbody = '{' (enumconst (',' enumconst)*)? ','? (';' member*)? '}'
enumconst = annots? NAME arglist? classbody?
@member = ';' | 'static'? block | typedecl | mods tparams? annots? memberrest
memberrest = NAME '(' params? ')' throws? block | NAME block | ('void' | type) NAME ('(' params? ')' dims throws? (block | ('default' annval)? ';') | vardecls ';')
vardecls = dims ('=' init)? (',' NAME dims ('=' init)?)*
dims = (annots? '[' ']')*
init = '{' (init (',' init)*)? ','? '}' | expr
throws = 'throws' types
params = param (',' param)*
param = (annot | 'final')* type annots? '...'? (NAME '.')? (NAME | 'this' | '_') dims
tparams = '<' (annots? NAME ('extends' type ('&' type)*)?) % ',' '>'
@type = annots? (prim | NAME targs? ('.' annots? NAME targs?)*) dims
prim = 'int' | 'long' | 'short' | 'byte' | 'char' | 'boolean' | 'float' | 'double'
targs = '<' (targ (',' targ)*)? '>'
targ = annots? '?' (('extends' | 'super') type)? | type
block = '{' stmt* '}'
@stmt = block | ';' | 'if' '(' expr ')' stmt ('else' stmt)? | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';' | 'for' '(' forhead ')' stmt | 'return' expr? ';' | 'break' NAME? ';' | 'continue' NAME? ';' | 'throw' expr ';' | 'try' ('(' res (';' res)* ';'? ')')? block ('catch' '(' (annot | 'final')* type ('|' type)* (NAME | '_') ')' block)* ('finally' block)? | 'switch' '(' expr ')' switchbody | 'synchronized' '(' expr ')' block | 'assert' expr (':' expr)? ';' | 'yield' !'=' !'.' !'(' expr ';' | NAME ':' stmt | local ';' | localtype | expr ';'
localtype = typedecl
local = (annot | 'final')* type (NAME | '_') vardecls
forhead = (annot | 'final')* type (NAME | '_') ':' expr | (local | expr % ',')? ';' expr? ';' (expr % ',')?
res = (annot | 'final')* type (NAME | '_') '=' expr | postfix
switchbody = '{' (caserule+ | (('case' caselabel (',' caselabel)* guard? | 'default') ':' stmt*)*) '}'
caserule = ('case' caselabel (',' caselabel)* guard? | 'default') '->' (block | 'throw' expr ';' | expr ';')
guard = 'when' expr
caselabel = 'null' | 'default' | pattern | ternary !'->' | ternary
pattern = ('final' | annot)* type (NAME | '_') &(':' | '->' | ',' | 'when' | ')' | '&&' | '||' | '?' | ';') | type '(' (pattern (',' pattern)*)? ')' NAME?
@expr = lambda | ternary (ASSIGN expr | '=' expr | '>' '>' ('>')? '=' expr)?
lambda = (NAME | '_' | '(' ((param (',' param)*) | (NAME | '_') % ',')? ')') '->' (block | expr)
ternary = unary binary* ('?' (lambda | expr) ':' (lambda | ternary))?
binary = 'instanceof' ('final'? pattern | 'final'? type NAME?) | (BINOP | '<' '='? | '>' ('>' '>'?)? !'=' | '>' '=' | '+' | '-' | '*' | '/' | '%' | '&' | '|' | '&&' | '||' | '^') unary
unary = ('+' | '-' | '!' | '~' | INC)* (cast | postfix)
cast = '(' prim dims ')' unary | '(' type ('&' type)* ')' (lambda | unarynot)
unarynot = ('!' | '~')* (cast | postfix)
@postfix = primary trailer* INC*
trailer = '.' (targs? (NAME | 'this' | 'super' | 'class') | 'new' creator) | arglist | '[' expr ']' | '::' targs? (NAME | 'new')
arglist = '(' (expr (',' expr)*)? ')'
primary = NUM | STR | CHAR | 'true' | 'false' | 'null' | 'this' | 'super' | 'switch' '(' expr ')' switchbody | 'new' creator | '(' expr ')' | prim dims ('.' 'class' | '::' 'new') | 'void' '.' 'class' | type '::' (NAME | 'new') | NAME ('[' ']')+ ('.' 'class' | '::' 'new') | NAME
creator = annots? targs? (prim | NAME targs? ('.' NAME targs?)*) (arglist classbody? | ('[' expr ']')+ dims | ('[' ']')+ init)
"""

GO_WORDS = set("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())

GO = r"""
file = ';'* 'package' NAME ';' (import ';')* (top ';')* EOF
import = 'import' (importspec | '(' (importspec ';')* importspec? ')')
importspec = ('.' | NAME)? STR
top = 'const' specs | 'var' vspecs | 'type' tspecs | 'func' (recv NAME | NAME tparams?) sig body?
specs = cspec | '(' (cspec ';')* cspec? ')'
cspec = NAME % ',' (type? '=' expr % ',')?
vspecs = vspec | '(' (vspec ';')* vspec? ')'
vspec = NAME % ',' ('=' expr % ',' | type ('=' expr % ',')?)
tspecs = tspec | '(' (tspec ';')* tspec? ')'
tspec = NAME (tparams !']')? '='? type
recv = '(' NAME? '*'? NAME ('[' (NAME % ',') ']')? ','? ')' | '(' NAME? '*'? NAME ('[' (type % ',') ']')? ')'
tparams = '[' (NAME % ',' constraint) % ',' ','? ']'
constraint = ('~'? type) % '|'
sig = params result?
result = params | type
params = '(' (param % ',' ','?)? ')'
param = NAME '...'? type | '...'? type
body = '{' stmts '}'
stmts = (stmt? ';')* stmt?
@type = NAME ('.' NAME)? ('[' type % ',' ','? ']')? | '*' type | '[' ('...' | expr)? ']' type | 'map' '[' type ']' type | 'chan' '<-'? type | '<-' 'chan' type | 'func' sig | 'struct' '{' (field ';')* field? '}' | 'interface' '{' (ifelem ';')* ifelem? '}' | '(' type ')'
field = ('*'? NAME ('.' NAME)? ('[' type % ',' ']')? &(STR | ';' | '}') | NAME % ',' type) STR?
ifelem = NAME sig | constraint
@stmt = 'const' specs | 'var' vspecs | 'type' tspecs | 'go' expr | 'defer' expr | 'return' (expr % ',')? | 'break' NAME? | 'continue' NAME? | 'goto' NAME | 'fallthrough' | body | ifst | switchst | selectst | forst | NAME ':' !'=' stmt? | simple
simple = expr % ',' (':=' expr % ',' | '=' expr % ',' | ASSIGN expr | INC | '<-' expr)?
hsimple = hexpr % ',' (':=' hexpr % ',' | '=' hexpr % ',' | ASSIGN hexpr | INC | '<-' hexpr)?
ifst = 'if' (hsimple? ';')? hsimple body ('else' (ifst | body))?
switchst = 'switch' (hsimple? ';')? (NAME ':=' hexpr | hsimple)? '{' (('case' (type | expr) % ',' | 'default') ':' stmts)* '}' | 'switch' (hsimple? ';')? (NAME ':=' hexpr | hsimple)? '{' (('case' expr % ',' | 'default') ':' stmts)* '}'
selectst = 'select' '{' (('case' simple | 'default') ':' stmts)* '}'
forst = 'for' ((hexpr % ',' (':=' | '='))? 'range' hexpr | hsimple? ';' hsimple? ';' hsimple? | hsimple)? body
@expr = unary (binop unary)*
@hexpr = hunary (binop hunary)*
binop = OP | '*' | '+' | '-' | '^' | '&' | '|'
unary = UN* primary
hunary = UN* hprimary
UNX = UN
@primary = operand trailer*
@hprimary = hoperand trailer*
trailer = '.' (NAME | '(' ('type' | type) ')') | '[' (expr? ':' expr? (':' expr)? | (type | expr) % ',' ','?) ']' | '[' expr % ',' ','? ']' | '(' ((argx % ',' '...'? ','?))? ')'
argx = expr | type
operand = NUM | STR | CHAR | 'func' sig body? | complit | '(' (expr | type) ')' | convtype &'(' | NAME
hoperand = NUM | STR | CHAR | 'func' sig body? | hcomplit | '(' (expr | type) ')' | convtype &'(' | NAME
convtype = '[' expr? ']' type | 'map' '[' type ']' type | 'chan' type | 'interface' '{' '}' | 'struct' '{' '}' | '*' type
complit = littype lit
hcomplit = hlittype lit
hlittype = '[' ('...' | expr)? ']' type | 'map' '[' type ']' type | 'struct' '{' (field ';')* field? '}'
littype = hlittype | NAME ('.' NAME)? ('[' type % ',' ']')?
lit = '{' (litel (',' litel)* ','?)? '}'
litel = (lit | expr) (':' (lit | expr))?
""".replace("UNX = UN\n", "").replace("UN*", "('+' | '-' | '!' | '^' | '*' | '&' | '<-' | '~')*")

RUST_WORDS = set("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while".split())

RUST = r"""
file = inner* item* EOF
inner = '#' '!' '[' tree* ']'
attr = '#' '[' tree* ']'
tree = '(' tree* ')' | '[' tree* ']' | '{' tree* '}' | !')' !']' !'}' !EOF ANY
@item = attr* vis? itemx
vis = 'pub' ('(' ('crate' | 'self' | 'super' | 'in' path) ')')?
itemx = 'use' usetree ';' | 'mod' NAME (';' | '{' inner* item* '}') | 'extern' 'crate' (NAME | 'self') ('as' NAME)? ';' | fnx | 'unsafe'? 'extern' STR? '{' inner* item* '}' | 'type' NAME generics? (':' bounds?)? where? ('=' type where?)? ';' | 'struct' NAME generics? (where? '{' fields? '}' | '(' tfields? ')' where? ';' | where? ';') | 'enum' NAME generics? where? '{' (variant (',' variant)* ','?)? '}' | 'union' NAME generics? where? '{' fields? '}' | 'const' (NAME | '_') ':' type ('=' expr)? ';' | 'static' 'mut'? NAME ':' type ('=' expr)? ';' | 'unsafe'? 'auto'? 'trait' NAME generics? (':' bounds?)? where? ('{' inner* item* '}' | ';') | 'unsafe'? 'impl' generics? ('const'? '!'? type 'for')? type where? '{' inner* item* '}' | 'macro_rules' '!' NAME ('{' tree* '}' | '(' tree* ')' ';' | '[' tree* ']' ';') | path '!' NAME? ('{' tree* '}' | ('(' tree* ')' | '[' tree* ']') ';')
usetree = '::'? ('*' | '{' (usetree (',' usetree)* ','?)? '}' | seg ('::' seg)* ('::' ('*' | '{' (usetree (',' usetree)* ','?)? '}'))? ('as' (NAME | '_'))?)
seg = NAME | 'crate' | 'self' | 'super' | 'Self'
fnx = ('const' | 'async' | 'unsafe' | 'extern' STR? | 'safe')* 'fn' NAME generics? '(' fparams? ')' ('->' type)? where? (block | ';')
fparams = fparam (',' fparam)* ','?
fparam = attr* (('&' LIFE? )? 'mut'? 'self' (':' type)? | pat ':' ('...' | type) | '...' | type)
generics = '<' (gparam (',' gparam)* ','?)? '>'
gparam = attr* (LIFE (':' (LIFE ('+' LIFE)*)?)? | 'const' NAME ':' type ('=' (block | '-'? lit | NAME))? | NAME (':' bounds?)? ('=' type)?)
where = 'where' (wpred (',' wpred)* ','?)?
wpred = LIFE ':' (LIFE ('+' LIFE)*)? | forlt? type ':' bounds?
forlt = 'for' generics
bounds = bound ('+' bound)* '+'?
bound = LIFE | '(' bound ')' | ('?' | '~' 'const')? forlt? path | 'use' generics
fields = field (',' field)* ','?
field = attr* vis? NAME ':' type
tfields = tfield (',' tfield)* ','?
tfield = attr* vis? type
variant = attr* vis? NAME ('{' fields? '}' | '(' tfields? ')')? ('=' expr)?
@type = '(' (type (',' type)* ','?)? ')' | '!' | '&' LIFE? 'mut'? type | '&&' LIFE? 'mut'? type | '*' ('const' | 'mut') type | '[' type (';' expr)? ']' | ('dyn' | 'impl') bounds | '_' | forlt? ('unsafe' | 'extern' STR?)* 'fn' '(' ((attr* ((NAME | '_') ':')? type) % ',' ','?)? ('...')? ')' ('->' type)? | forlt bound | '<' type ('as' path)? '>' ('::' pseg)+ | path '!' tt | path
tt = '(' tree* ')' | '[' tree* ']' | '{' tree* '}'
@path = '::'? pseg ('::' pseg)*
pseg = seg (('::')? gargs | '(' (type (',' type)* ','?)? ')' ('->' type)?)?
@gargs = '<' (garg (',' garg)* ','?)? '>'
garg = LIFE | NAME gargs? ('=' type | ':' bounds) | type | block | '-'? lit
@epath = ('<' type ('as' path)? '>' | '::'? eseg) ('::' (eseg | gargs))*
eseg = seg
lit = NUM | STR | CHAR | 'true' | 'false'
block = '{' inner* stmts '}'
stmts = (stmt)* (attr* expr)?
@stmt = ';' | attr* 'let' pat (':' type)? ('=' expr ('else' block)?)? ';' | !'unsafe' !path0 item | item2 | attr* blockexpr !'.' !'?' ';'? | attr* expr ';' | macrostmt
macrostmt = attr* path '!' '{' tree* '}'
path0 = path '!'
item2 = attr* 'unsafe' ('fn' | 'impl' | 'trait' | 'extern') NEVER | &('unsafe' ('fn' | 'impl' | 'trait' | 'extern')) item | 'macro_rules' '!' NAME tt
blockexpr = (LIFE ':')? ('unsafe' block | 'async' 'move'? block | 'const' block | block | ifx | 'match' hexpr '{' inner* arms '}' | 'loop' block | 'while' cond block | 'for' pat 'in' hexpr block)
ifx = 'if' cond block ('else' (ifx | block))?
cond = condp ('&&' condp)*
condp = 'let' pat '=' hcmp | hexpr
hcmp = hunary (hbin hunary)*
hbin = OP | '*' | '-' | '+' | '<' '='? | '>' '='? | '>' '>' | '|' | '||' | '&' | '..' | '..='
arms = (arm)* 
arm = attr* pat ('if' armguard)? '=>' (blockexpr &(','? (attr | '}' | patstart)) !'.' !'?' ','? | expr (',' | &'}'))
armguard = condg ('&&' condg)*
condg = 'let' pat '=' hcmp2 | expr
hcmp2 = unary (hbin unary)*
patstart = 'NEVERMATCH' | NAME | lit | '_' | '(' | '[' | '&' | '|' | 'ref' | 'mut' | seg | '..' | '-' | '<' | '::' | 'const' | '..='
@pat = '|'? pat1 ('|' pat1)*
pat1 = '&' 'mut'? pat1 | '&&' 'mut'? pat1 | '_' | '..' !rangeend | '(' (pat (',' pat)* ','?)? ')' | '[' (pat (',' pat)* ','?)? ']' | 'ref' 'mut'? NAME ('@' pat1)? | 'mut' NAME ('@' pat1)? | ('..=' | '..') rangeend | rangeend ('..=' | '...' | '..') rangeend? | '-'? lit | NAME '@' pat1 | 'const' block | path '!' tt | epath ('{' (fpat (',' fpat)* ','?)? '}' | '(' (pat (',' pat)* ','?)? ')')?
rangeend = '-'? lit | epath !'(' !'{' !'!'
fpat = attr* ('..' | 'ref'? 'mut'? NAME !':' | (NAME | NUM) ':' pat)
@expr = closure | jump | unary (bin (closure | jump | unary) | 'as' type | ('..' | '..=') (closure | jump | unary)?)*
@hexpr = closure | jump | hunary (bin (closure | jump | hunary) | 'as' type | ('..' | '..=') (closure | jump | hunary)?)*
bin = ASSIGN | '=' | OP | '*' | '-' | '+' | '<' '<'? '='? | '>' '>'? '='? | '|' | '||' | '&' | '&&'
closure = ('static' | 'async')? 'move'? ('||' | '|' (cparam (',' cparam)* ','?)? '|') ('->' type block | expr)
cparam = attr* pat1 (':' type)?
jump = 'return' expr? | 'break' LIFE? expr? | 'continue' LIFE? | ('..' | '..=') (unary (bin unary)*)?
unary = ('-' | '!' | '*' | '&' 'raw' ('const' | 'mut') | '&' 'mut'? | '&&' 'mut'?)* postfix
hunary = ('-' | '!' | '*' | '&' 'mut'? | '&&' 'mut'?)* hpostfix
@postfix = primary trailer*
@hpostfix = hprimary trailer*
trailer = '?' | '.' ('await' | NUM | NAME ('::' gargs)?) | '(' ((attr* expr) % ',' ','?)? ')' | '[' expr ']'
primary = lit | blockexpr | '(' (expr (',' expr)* ','?)? ')' | '[' (expr (';' expr | (',' expr)* ','?)?)? ']' | closure | jump | path0x tt | epath slit | epath | '_'
hprimary = lit | blockexpr | '(' (expr (',' expr)* ','?)? ')' | '[' (expr (';' expr | (',' expr)* ','?)?)? ']' | closure | jump | path0x tt | epath | '_'
path0x = path '!'
slit = '{' (sfield (',' sfield)* ','?)? ('..' expr?)? '}'
sfield = attr* ('..' expr | (NAME | NUM) ':' expr | NAME)
""".replace("'NEVERMATCH' | ", "").replace(" | RANGEEND", "")

CSHARP_WORDS = set("abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual void volatile while".split())

CSHARP = r"""
file = (externa | using)* (attrs0)* (nsfile | nsmember | stmt)* EOF
externa = 'extern' 'alias' NAME ';'
using = 'global'? 'using' 'static'? (NAME '=' type | qname targs?) ';'
attrs0 = '[' ('assembly' | 'module') ':' attrlist ']'
nsfile = 'namespace' qname ';'
nsmember = 'namespace' qname '{' (externa | using)* nsmember* '}' ';'? | typedecl
qname = NAME ('::' NAME)? ('.' NAME)*
attrs = ('[' (NAME ':' | 'return' ':' | 'event' ':')? attrlist ']')*
attrlist = attrx (',' attrx)* ','?
attrx = qname targs? ('(' (attrarg % ',')? ')')?
attrarg = NAME '=' expr | NAME ':' expr | expr
mods = ('public' | 'private' | 'protected' | 'internal' | 'static' | 'abstract' | 'sealed' | 'virtual' | 'override' | 'readonly' | 'new' | 'extern' | 'unsafe' | 'volatile' | 'async' !'(' !'=' | 'partial' &partnext | 'required' &partnext2 | 'file' &partnext | 'const' | 'ref' &partnext3 | 'fixed')*
partnext = 'class' | 'struct' | 'interface' | 'record' | 'void' | 'ref' | 'partial' | 'static' | 'enum' | 'delegate' | 'async' | 'abstract' | 'sealed' | prim | NAME
partnext2 = mods2 type
mods2 = ('public' | 'private' | 'protected' | 'internal' | 'override' | 'virtual' | 'readonly' | 'static')*
partnext3 = 'struct' | 'partial' | 'readonly' | type
@typedecl = attrs mods (('class' | 'struct' | 'interface' | 'record' ('class' | 'struct')?) NAME tparams? ('(' params? ')')? (':' basetype (',' basetype)*)? constraints ('{' member* '}' ';'? | ';') | 'enum' NAME (':' type)? '{' (enumel (',' enumel)* ','?)? '}' ';'? | 'delegate' rtype NAME tparams? '(' params? ')' constraints ';')
basetype = type ('(' args? ')')?
enumel = attrs NAME ('=' expr)?
tparams = '<' (attrs ('in' | 'out')? NAME) % ',' '>'
constraints = ('where' NAME ':' ('class' '?'? | 'struct' | 'new' '(' ')' | 'notnull' | 'unmanaged' | 'default' | type) % ',')*
rtype = 'void' | 'ref' 'readonly'? type | type
@type = ptype (('?' !(!'[' !')' !'>' !',' !';' !'=' !'{' !NAME !'(' !'?' !'.' !':' !'&&' !'||' !'is' !'|' !']' !'=>' !'in') | '*' &(')' | NAME | '*' | '>') | '[' ','* ']'))*
ptype = 'void' &'*' | prim | '(' type NAME? (',' type NAME?)+ ')' | 'delegate' '*' ('managed' | 'unmanaged')? '<' type % ',' '>' | NAME ('::' NAME)? targs? ('.' NAME targs?)*
prim = 'bool' | 'byte' | 'sbyte' | 'short' | 'ushort' | 'int' | 'uint' | 'long' | 'ulong' | 'float' | 'double' | 'decimal' | 'char' | 'string' | 'object'
@targs = '<' (attrs type) % ',' '>' | '<' ','* '>'
params = (attrs param) % ','
param = ('this' | 'ref' 'readonly'? | 'out' | 'in' | 'params' | 'scoped')* type NAME ('=' expr)? | '__arglist'
@member = typedecl | attrs mods memberx
memberx = NAME '(' params? ')' (':' ('base' | 'this') '(' args? ')')? body | '~' NAME '(' ')' body | 'event' type (NAME ('=' expr)? (',' NAME ('=' expr)?)* ';' | qname '{' accessor* '}') | ('implicit' | 'explicit') 'operator' 'checked'? type '(' params? ')' body | rtype 'operator' 'checked'? opname '(' params? ')' body | rtype (ifacename '.')? 'this' '[' params ']' propbody | rtype (ifacename '.')? NAME (propbody ('=' expr ';')? | tparams? '(' params? ')' constraints body | ('[' expr ']')? ('=' init)? (',' NAME ('=' init)?)* ';')
ifacename = NAME targs? ('.' NAME targs? &'.')*
opname = '+' | '-' | '!' | '~' | INC | '*' | '/' | '%' | '&' | '|' | '^' | '<' '<'? '='? | '>' ('>' '>'?)? '='? | OP | 'true' | 'false'
propbody = '{' accessor* '}' | '=>' expr ';'
accessor = attrs ('public' | 'private' | 'protected' | 'internal' | 'readonly')* ('get' | 'set' | 'init' | 'add' | 'remove') body
body = block | '=>' expr ';' | ';'
init = '{' (init (',' init)* ','?)? '}' | expr
block = '{' stmt* '}'
@stmt = block | ';' | 'if' '(' expr ')' stmt ('else' stmt)? | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';' | 'for' '(' (local | expr % ',')? ';' expr? ';' (expr % ',')? ')' stmt | 'await'? 'foreach' '(' ('ref' 'readonly'?)? (type NAME | 'var'? '(' tupledecl ')') 'in' expr ')' stmt | 'return' ('ref'? expr)? ';' | 'break' ';' | 'continue' ';' | 'goto' (NAME | 'case' expr | 'default') ';' | 'throw' expr? ';' | 'try' block ('catch' ('(' type NAME? ')')? ('when' '(' expr ')')? block)* ('finally' block)? | 'switch' '(' expr ')' '{' (('case' pattern ('when' expr)? ':' | 'default' ':')+ stmt*)* '}' | 'lock' '(' expr ')' stmt | 'await'? 'using' '(' (local | expr) ')' stmt | 'await'? 'using' local ';' | 'fixed' '(' local ')' stmt | ('checked' | 'unchecked' | 'unsafe') block | 'yield' ('return' expr | 'break') ';' | NAME ':' !':' stmt | localfn | 'const'? 'scoped'? ('ref' 'readonly'?)? local ';' | expr ';'
local = type localvar (',' localvar)*
localvar = NAME ('=' ('ref'? init))?
localfn = attrs ('static' | 'async' | 'unsafe' | 'extern')* rtype NAME tparams? '(' params? ')' constraints (block | '=>' expr ';')
tupledecl = tupleel (',' tupleel)*
tupleel = type NAME | NAME | '(' tupledecl ')'
@expr = lambda | query | 'throw' expr | ternary ((ASSIGN | '=' | '??=' | '>' '>' '>'? '=') ('ref'? expr))?
query = 'from' (type NAME | NAME) 'in' expr qclause+
qclause = 'from' (type NAME | NAME) 'in' expr | 'where' expr | 'let' NAME '=' expr | 'join' (type NAME | NAME) 'in' expr 'on' expr 'equals' expr ('into' NAME)? | 'orderby' (expr ('ascending' | 'descending')?) % ',' | 'select' expr | 'group' expr 'by' expr | 'into' NAME
lambda = attrs ('static' | 'async')* (NAME | rtype? '(' lparams? ')') '=>' ('ref'? expr | block) | 'async'? 'static'? 'delegate' ('(' params? ')')? block
lparams = lparam % ','
lparam = attrs ('ref' | 'out' | 'in' | 'params' | 'scoped')* (type NAME ('=' expr)? | NAME)
ternary = unary binary* ('?' ('ref'? expr) ':' ('ref'? expr))?
binary = 'is' pattern | 'as' type | 'switch' '{' (swarm (',' swarm)* ','?)? '}' | 'with' '{' (NAME '=' expr) % ',' ','? '}' | (OP | '<' '<'? '='? | '>' ('>' '>'?)? !'=' | '>' '=' | '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '&&' | '||' | '??' | '..') ('throw' expr | lambda | unary)?
swarm = pattern ('when' expr)? '=>' expr
@pattern = patand ('or' patand)*
patand = patnot ('and' patnot)*
patnot = 'not'* patprim
patprim = '(' pattern ')' desig? !'=>' !'{' | ('<' | '>') '='? unary | 'var' (NAME | '(' tupledecl ')') | '[' ((pattern | '..' pattern?) % ',' ','?)? ']' desig? | type? ('(' (subpat % ',')? ')')? '{' (subpat (',' subpat)* ','?)? '}' desig? | type '(' (subpat % ',')? ')' desig? | '(' subpat (',' subpat)* ')' desig? | type desig !'(' | '_' | unary binary2*
binary2 = ('+' | '-' | '*' | '/' | '|' | '&') unary
desig = !'or' !'and' !'when' !'where' !'orderby' !'select' NAME
subpat = (NAME ('.' NAME)* ':')? pattern
unary = ('+' | '-' | '!' | '~' | INC | '&' | '*' | '^' | '..' | 'await' &awaited)* (cast | postfix)
awaited = NAME | 'this' | 'base' | '(' | 'new' | 'default' | STR | 'typeof' | prim
cast = '(' prim ('?' | '[' ','* ']' | '*')* ')' unary | '(' type ')' &castnext unary
castnext = NAME | NUM | STR | CHAR | '(' | 'this' | 'base' | 'new' | 'true' | 'false' | 'null' | 'typeof' | 'default' | '!' | '~' | prim | 'sizeof' | 'checked' | 'stackalloc' | 'await'
@postfix = primary trailer* 
trailer = '.' NAME (targs &targsnext)? | '?' '.' NAME (targs &targsnext)? | '?' '[' args ']' | '(' args? ')' | '[' args ']' | INC | '!' !'=' | '->' NAME
targsnext = '(' | ')' | ']' | '}' | ':' | ';' | ',' | '.' | '?' | '==' | '{' | '&&' | '||' | '[' | EOF
args = arg % ','
arg = (NAME ':' !':')? ('ref' | 'in')? ('out' (type NAME | 'var'? '(' tupledecl ')') | 'out'? (lambda | expr))
primary = NUM | STR STR* | CHAR | 'true' | 'false' | 'null' | 'this' | 'base' | '(' (expr (',' (NAME ':' !':')? expr)* | NAME ':' !':' expr (',' (NAME ':' !':')? expr)*) ')' | '(' type NAME (',' type NAME)+ ')' | 'new' newx | ('typeof' | 'sizeof') '(' ('void' | type) ')' | ('checked' | 'unchecked') '(' expr ')' | 'default' ('(' type ')')? | 'stackalloc' (type? ('[' expr? ']')? )? objinit? | 'nameof' '(' expr ')' | prim | '[' ((('..' expr) | expr) % ',' ','?)? ']' | 'var' '(' tupledecl ')' | NAME '::' NAME | NAME (targs &targsnext)?
newx = '(' args? ')' objinit? | '[' ','* ']' init | objinit | newtype (('[' args ']') ('[' ','* ']')* init? | '(' args? ')' objinit? | objinit)
newtype = ('void' '*' | prim | '(' type NAME? (',' type NAME?)+ ')' | NAME ('::' NAME)? targs? ('.' NAME targs?)*) '?'? ('[' ','* ']' &'{')*
objinit = '{' (objel (',' objel)* ','?)? '}'
objel = '[' args ']' '=' (objinit | expr) | NAME '=' ('ref'? (objinit | expr)) | objinit | expr
"""

SQL_WORDS = set("ADD ALL ALTER AND AS ASC BETWEEN BY CASE CHECK COLUMN CONSTRAINT CREATE CROSS DEFAULT DELETE DESC DISTINCT DROP ELSE END EXCEPT EXISTS FOREIGN FROM FULL GROUP HAVING IN INDEX INNER INSERT INTERSECT INTO IS JOIN LEFT LIKE LIMIT NOT NULL ON OR ORDER OUTER PRIMARY REFERENCES RIGHT SELECT SET TABLE THEN UNION UNIQUE UPDATE USING VALUES VIEW WHEN WHERE WITH".split())

SQL = r"""
file = ';'* (stmt (';'+ | &EOF))* EOF
@stmt = create | alter | drop | query | insert | update | delete | misc
create = 'CREATE' ('OR' 'REPLACE')? ('GLOBAL' | 'LOCAL')? ('TEMPORARY' | 'TEMP' | 'UNLOGGED' | 'EXTERNAL')? (ctable | cindex | cview | cfunc | 'SCHEMA' notexists? qname? ('AUTHORIZATION' NAME)? | 'SEQUENCE' notexists? qname seqopt* | ctype | 'EXTENSION' notexists? NAME ('WITH'? 'SCHEMA' NAME)? | ctrigger | 'DATABASE' notexists? NAME colopt0* | ('ROLE' | 'USER') NAME (NAME | STR | 'WITH' | 'IN')* | 'POLICY' NAME 'ON' qname anything | 'DOMAIN' qname 'AS'? dtype colopt*)
notexists = 'IF' 'NOT' 'EXISTS'
ifexists = 'IF' 'EXISTS'
qname = name ('.' name)*
name = NAME | QNAME
ctable = 'TABLE' notexists? qname ('(' (tabel (',' tabel)*) ')' tabopt* ('AS' query)? | ('(' name % ',' ')')? tabopt* 'AS' '('? query ')'? | 'PARTITION' 'OF' qname anything | 'LIKE' qname)
tabopt = 'WITH' '(' anyparen ')' | 'WITHOUT' 'ROWID' | 'STRICT' | 'INHERITS' '(' qname % ',' ')' | 'PARTITION' 'BY' NAME '(' expr % ',' ')' | 'TABLESPACE' NAME | ('ENGINE' | 'CHARSET' | 'COLLATE' | 'COMMENT' | 'AUTO_INCREMENT' | 'ROW_FORMAT') '='? (NAME | STR | NUM) | 'DEFAULT' ('CHARSET' | 'CHARACTER' 'SET') '='? NAME | 'ON' 'COMMIT' NAME NAME? | ','
tabel = tabcon | name dtype? colopt* | 'LIKE' qname ((NAME) NAME)*
tabcon = ('CONSTRAINT' name)? ('PRIMARY' 'KEY' idxtype? '(' idxcol % ',' ')' conopt* | 'UNIQUE' ('KEY' | 'INDEX')? name? ('NULLS' 'NOT'? 'DISTINCT')? '(' idxcol % ',' ')' conopt* | 'FOREIGN' 'KEY' name? '(' name % ',' ')' refs | 'CHECK' '(' expr ')' conopt* | ('INDEX' | 'KEY') name? '(' idxcol % ',' ')' | 'EXCLUDE' anything)
idxtype = 'CLUSTERED' | 'NONCLUSTERED'
conopt = 'ON' 'CONFLICT' NAME | defer | 'USING' NAME+ | 'INCLUDE' '(' name % ',' ')'
defer = 'NOT'? 'DEFERRABLE' | 'INITIALLY' ('DEFERRED' | 'IMMEDIATE') | 'NOT' 'VALID' | 'NOT'? 'ENFORCED'
refs = 'REFERENCES' qname ('(' name % ',' ')')? refopt*
refopt = 'ON' ('DELETE' | 'UPDATE') ('CASCADE' | 'RESTRICT' | 'SET' ('NULL' | 'DEFAULT') ('(' name % ',' ')')? | 'NO' 'ACTION') | 'MATCH' ('FULL' | NAME) | defer
dtype = ('DOUBLE' 'PRECISION' | ('CHARACTER' | 'CHAR' | 'NATIONAL') ('VARYING' | 'CHARACTER' | 'CHAR' | 'LARGE')* | 'LONG' ('VARCHAR' | 'TEXT')? | ('TIMESTAMP' | 'TIME') ('(' NUM ')')? (('WITH' | 'WITHOUT') 'LOCAL'? 'TIME' 'ZONE')? | 'ENUM' '(' STR % ',' ')' | 'SET' '(' STR % ',' ')' | 'INTERVAL' NAME* | qname) ('(' (NUM | NAME | STR) % ',' ('CHAR' | 'BYTE')? ')')? ('UNSIGNED' | 'SIGNED' | 'ZEROFILL')* ('[' NUM? ']' | 'ARRAY')* 
colopt0 = NAME | STR | '=' | 'DEFAULT' | 'SET' | 'WITH'
colopt = ('CONSTRAINT' name)? (('NOT')? 'NULL' ('ON' 'CONFLICT' NAME)? | 'DEFAULT' defval | 'PRIMARY' 'KEY' ('ASC' | 'DESC')? ('AUTOINCREMENT' | idxtype)? ('ON' 'CONFLICT' NAME)? | 'UNIQUE' 'KEY'? ('ON' 'CONFLICT' NAME)? | 'CHECK' '(' expr ')' | refs | 'COLLATE' qname | 'AUTO_INCREMENT' | 'AUTOINCREMENT' | 'IDENTITY' ('(' NUM ',' NUM ')')? | 'GENERATED' ('ALWAYS' | 'BY' 'DEFAULT') 'AS' ('IDENTITY' ('(' seqopt* ')')? | '(' expr ')' ('STORED' | 'VIRTUAL')?) | 'AS' '(' expr ')' ('STORED' | 'VIRTUAL' | 'PERSISTED')? | 'COMMENT' STR | 'ON' 'UPDATE' expr | defer | 'CHARACTER' 'SET' NAME | 'STORAGE' NAME)
defval = '(' expr ')' | ('+' | '-')? NUM cast* | STR cast* | 'NULL' cast* | 'TRUE' | 'FALSE' | 'NEXT' 'VALUE' 'FOR' qname | func cast* | NAME STR? cast*
seqopt = ('START' | 'INCREMENT') ('WITH' | 'BY')? '-'? NUM | ('MINVALUE' | 'MAXVALUE' | 'CACHE') '-'? NUM | 'NO' ('MINVALUE' | 'MAXVALUE' | 'CYCLE' | 'CACHE') | 'CYCLE' | 'OWNED' 'BY' qname | 'AS' dtype
cindex = 'UNIQUE'? ('CLUSTERED' | 'NONCLUSTERED' | 'FULLTEXT' | 'SPATIAL')? 'INDEX' 'CONCURRENTLY'? notexists? (qname)? 'ON' 'ONLY'? qname ('USING' NAME)? '(' idxcol % ',' ')' ('INCLUDE' '(' name % ',' ')')? ('WITH' '(' anyparen ')')? ('TABLESPACE' NAME)? ('WHERE' expr)?
idxcol = expr ('COLLATE' qname)? (!'NULLS' NAME)? ('ASC' | 'DESC')? ('NULLS' ('FIRST' | 'LAST'))?
cview = ('RECURSIVE' | 'MATERIALIZED')? 'VIEW' notexists? qname ('(' name % ',' ')')? ('WITH' '(' anyparen ')')? 'AS' query ('WITH' ('NO' 'DATA' | 'DATA' | ('CASCADED' | 'LOCAL')? 'CHECK' 'OPTION'))?
cfunc = ('FUNCTION' | 'PROCEDURE') notexists? qname '(' ((('IN' | 'OUT' | 'INOUT' | 'VARIADIC')? name dtype? (('DEFAULT' | '=') expr)?) % ',')? ')' funcopt+
funcopt = 'RETURNS' ('SETOF'? dtype | 'TABLE' '(' (name dtype) % ',' ')' | 'NULL' 'ON' 'NULL' 'INPUT' | 'TRIGGER') | 'LANGUAGE' (NAME | STR) | 'AS' (STR (',' STR)?) | 'IMMUTABLE' | 'STABLE' | 'VOLATILE' | 'STRICT' | 'SECURITY' NAME | 'PARALLEL' NAME | 'COST' NUM | 'DETERMINISTIC' | 'RETURN' expr | 'BEGIN' (stmt ';')* 'END' | 'CALLED' 'ON' 'NULL' 'INPUT' | 'SET' name ('=' | 'TO') expr
ctype = 'TYPE' qname ('AS' ('ENUM' '(' (STR % ',')? ')' | '(' (name dtype) % ',' ')' | 'RANGE' '(' anyparen ')'))?
ctrigger = 'CONSTRAINT'? 'TRIGGER' notexists? qname ('BEFORE' | 'AFTER' | 'INSTEAD' 'OF') (('INSERT' | 'DELETE' | 'UPDATE' ('OF' name % ',')? | 'TRUNCATE') % 'OR') 'ON' qname ('REFERENCING' anything0)? ('FOR' 'EACH'? ('ROW' | 'STATEMENT'))? ('WHEN' '(' expr ')')? ('EXECUTE' ('FUNCTION' | 'PROCEDURE') qname '(' (expr % ',')? ')' | 'BEGIN' (stmt ';')+ 'END')
anything0 = (NAME | 'AS' | 'TABLE')*
alter = 'ALTER' ('TABLE' ifexists? 'ONLY'? qname altact (',' altact)* | ('SEQUENCE' | 'INDEX' | 'TYPE' | 'VIEW' | 'SCHEMA' | 'DATABASE' | 'FUNCTION' | 'ROLE' | 'USER') ifexists? qname anything)
altact = 'ADD' ('COLUMN'? notexists? tabel | '(' tabel % ',' ')') (('FIRST') | 'AFTER' name)? | 'DROP' ('COLUMN' | 'CONSTRAINT' | 'INDEX' | 'PRIMARY' 'KEY' | 'FOREIGN' 'KEY')? ifexists? name? ('CASCADE' | 'RESTRICT')? | 'ALTER' 'COLUMN'? name ('SET' ('NOT' 'NULL' | 'DEFAULT' expr | 'DATA' 'TYPE' dtype ('USING' expr)? | 'STATISTICS' NUM | 'STORAGE' NAME) | 'DROP' ('NOT' 'NULL' | 'DEFAULT' | 'IDENTITY' ifexists? | 'EXPRESSION') | 'TYPE' dtype ('COLLATE' qname)? ('USING' expr)? | dtype colopt*) | 'RENAME' ('COLUMN' | 'CONSTRAINT')? (!'TO' name)? 'TO' qname | 'OWNER' 'TO' name | 'SET' anything1 | ('MODIFY' | 'CHANGE') 'COLUMN'? name name? dtype colopt* | ('ENABLE' | 'DISABLE') anything1 | 'ATTACH' anything1 | 'VALIDATE' 'CONSTRAINT' name | 'INHERIT' qname
anything1 = (NAME | STR | NUM | '(' anyparen ')' | '=' | 'WITH' | 'ALL' | '.')+
drop = 'DROP' ('TABLE' | 'INDEX' | 'VIEW' | 'MATERIALIZED' 'VIEW' | 'SCHEMA' | 'SEQUENCE' | 'FUNCTION' | 'PROCEDURE' | 'TRIGGER' | 'TYPE' | 'DATABASE' | 'EXTENSION' | 'ROLE' | 'USER' | 'POLICY' | 'DOMAIN') 'CONCURRENTLY'? ifexists? (qname ('(' (dtype % ',')? ')')?) % ',' ('ON' qname)? ('CASCADE' | 'RESTRICT')?
@query = ('WITH' 'RECURSIVE'? (name ('(' name % ',' ')')? 'AS' ('NOT'? 'MATERIALIZED')? '(' (query | insert | update | delete) ')') % ',')? qterm (('UNION' | 'INTERSECT' | 'EXCEPT') ('ALL' | 'DISTINCT')? qterm)* ('ORDER' 'BY' ordering)? qlimit*
qlimit = 'LIMIT' (expr | 'ALL') (',' expr)? | 'OFFSET' expr ('ROWS' | 'ROW')? | 'FETCH' ('FIRST' | 'NEXT') NUM? ('ROWS' | 'ROW') ('ONLY' | 'WITH' NAME) | 'FOR' ('UPDATE' | NAME) anything0
ordering = (expr ('ASC' | 'DESC')? ('NULLS' ('FIRST' | 'LAST'))?) % ','
qterm = '(' query ')' | 'VALUES' ('(' expr % ',' ')') % ',' | 'TABLE' qname | 'SELECT' ('ALL' | 'DISTINCT' ('ON' '(' expr % ',' ')')?)? (selitem % ',') ('INTO' qname)? ('FROM' fromitem % ',')? ('WHERE' expr)? ('GROUP' 'BY' (grouping % ',' | 'ALL'))? ('HAVING' expr)? ('WINDOW' (name 'AS' '(' winspec ')') % ',')?
grouping = ('ROLLUP' | 'CUBE') '(' expr % ',' ')' | 'GROUPING' 'SETS' '(' anyparen ')' | expr
selitem = '*' | qname '.' '*' | expr ('AS' (name | STR) | notclause name)?
notclause = !'NATURAL' !'OFFSET' !'WINDOW' !'FETCH' !'FOR' !'RETURNING' !'SET'
fromitem = joined
joined = tabref (joinkind tabref ('ON' expr | 'USING' '(' name % ',' ')')?)*
joinkind = 'NATURAL'? ('INNER' | ('LEFT' | 'RIGHT' | 'FULL') 'OUTER'? | 'CROSS')? 'JOIN'
tabref = 'LATERAL'? ('(' query ')' | '(' joined ')' | qname ('(' (expr % ',')? ')')?) ('AS' name | notclause name)? ('(' name % ',' ')')?
insert = 'INSERT' ('OR' NAME)? 'INTO' qname ('AS' name)? ('(' name % ',' ')')? ('DEFAULT' 'VALUES' | 'VALUES' ('(' (expr | 'DEFAULT') % ',' ')') % ',' | query) ('ON' 'CONFLICT' ('(' idxcol % ',' ')' | 'ON' 'CONSTRAINT' name)? ('WHERE' expr)? 'DO' ('NOTHING' | 'UPDATE' 'SET' setitem % ',' ('WHERE' expr)?))? returning?
returning = 'RETURNING' selitem % ','
setitem = (qname | '(' name % ',' ')') '=' (expr | 'DEFAULT')
update = 'UPDATE' 'ONLY'? qname ('AS'? !'SET' name)? 'SET' setitem % ',' ('FROM' fromitem % ',')? ('WHERE' expr)? returning?
delete = 'DELETE' 'FROM' qname ('AS'? !'USING' notclause name)? ('USING' fromitem % ',')? ('WHERE' expr)? returning?
misc = ('BEGIN' | 'COMMIT' | 'ROLLBACK' | 'START') ('TRANSACTION' | 'WORK')? | 'SET' anything1 | ('GRANT' | 'REVOKE') anything | 'COMMENT' 'ON' anything2 'IS' (STR | 'NULL') | ('PRAGMA' | 'USE' | 'ANALYZE' | 'VACUUM' | 'REINDEX' | 'EXPLAIN') anything | 'TRUNCATE' 'TABLE'? qname % ',' ('CASCADE' | 'RESTRICT' | NAME)* | 'REFRESH' 'MATERIALIZED' 'VIEW' 'CONCURRENTLY'? qname | 'DO' STR | 'CALL' func
anything2 = (NAME | QNAME | 'TABLE' | 'COLUMN' | 'VIEW' | 'INDEX' | 'CONSTRAINT' | 'ON' | '.' | '(' anyparen ')')+
anything = anyitem*
anyitem = '(' anyparen ')' | !';' !')' !EOF !'CREATE' ANY
anyparen = ('(' anyparen ')' | !'(' !')' !';' !EOF ANY)*
@expr = unary (binop unary | postop)*
unary = ('NOT' | '-' | '+' | '~' | 'EXISTS' &'(')* primary
binop = OP | '=' | '*' | '-' | '+' | 'AND' | 'OR' | 'NOT'? ('LIKE' | 'ILIKE' | 'SIMILAR' 'TO' | 'REGEXP' | 'GLOB' | 'RLIKE') | 'IS' 'NOT'? 'DISTINCT' 'FROM' | 'AT' 'TIME' 'ZONE' | 'COLLATE' | 'ESCAPE'
postop = 'IS' 'NOT'? ('NULL' | 'TRUE' | 'FALSE' | 'UNKNOWN') | 'NOT'? 'IN' ('(' (query | expr % ',')? ')') | 'NOT'? 'BETWEEN' 'SYMMETRIC'? unary (arith unary)* 'AND' unary | 'ISNULL' | 'NOTNULL' | 'NOT' 'NULL'
arith = '+' | '-' | '*' | OP
cast = '::' dtype
@primary = prim1 (cast | '[' expr? (':' expr?)? ']' | '.' (name | '*'))*
prim1 = 'CASE' !'WHEN' expr ('WHEN' expr 'THEN' expr)+ ('ELSE' expr)? 'END' | 'CASE' ('WHEN' expr 'THEN' expr)+ ('ELSE' expr)? 'END' | 'CAST' '(' expr 'AS' dtype ')' | 'EXTRACT' '(' name 'FROM' expr ')' | ('SUBSTRING' | 'TRIM' | 'OVERLAY' | 'POSITION') '(' (NAME | expr)? (('FROM' | 'FOR' | 'IN' | 'PLACING') expr)* ')' | 'INTERVAL' STR NAME? | ('DATE' | 'TIMESTAMP' | 'TIME') STR | 'ARRAY' '[' (expr % ',')? ']' | 'ARRAY' '(' query ')' | func | ('LEFT' | 'RIGHT' | 'SET') '(' expr % ',' ')' | NUM | STR | 'NULL' | 'DEFAULT' | '(' (query | expr % ',') ')' | PARAM | qname
func = qname '(' ('DISTINCT' | 'ALL')? ('*' | (expr (('=>' | ':=') expr)?) % ',' ('ORDER' 'BY' ordering)?)? ')' ('WITHIN' 'GROUP' '(' 'ORDER' 'BY' ordering ')')? ('FILTER' '(' 'WHERE' expr ')')? ('OVER' ('(' winspec ')' | name))?
winspec = (!'PARTITION' !'ROWS' !'RANGE' !'GROUPS' name)? ('PARTITION' 'BY' expr % ',')? ('ORDER' 'BY' ordering)? (('ROWS' | 'RANGE' | 'GROUPS') frame)?
frame = 'BETWEEN' bound 'AND' bound | bound
bound = 'UNBOUNDED' ('PRECEDING' | 'FOLLOWING') | 'CURRENT' 'ROW' | expr ('PRECEDING' | 'FOLLOWING')
"""
