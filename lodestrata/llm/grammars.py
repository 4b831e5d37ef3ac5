"""Bundled grammars of Java, JavaScript and TypeScript (with JSX), and the tables made from them.

Notation: alternatives are tried in order; ``* + ?`` repeat; ``!x`` and ``&x`` look ahead; ``~`` means no line end before
the next token; ``EOS`` is a semicolon or a place where one is inserted; ``CALL`` holds where the token before ends a
call or a creation. ID is a name, NAME any word. Each choice becomes a table from the next token's type to the
alternatives that can begin with it, so most are taken without trying; rules marked @ keep their results per position.

A grammar is compiled into one table of instructions, which :meth:`Parser.parse` runs with stacks of its own for open
rules and for places to go back to. Nesting is bounded by memory only.
"""

from __future__ import annotations

import re
from functools import lru_cache

from . import lexing as L

JAVA = r"""
Unit: Mod* 'package' Qual ';' Rest | Rest ;
Rest: (Import | ';')* (ModuleDecl | (TypeDecl | ';' | Member)*) EOF ;
ModuleDecl: Annotation* ('open')? 'module' Qual '{' (ModDirective)* '}' ;
ModDirective: ('requires'|'exports'|'opens'|'uses'|'provides') ('static'|'transitive')* Qual (('to'|'with') Qual (',' Qual)*)? ';' ;
Import: 'import' 'static'? Qual ('.' '*')? ';' ;
Qual: ID ('.' ID)* ;
TypeDecl: Mod* TypeKind ;
TypeKind: 'class' ID TParams? ('extends' Type)? ('implements' Types)? ('permits' Types)? ClassBody
 | 'interface' ID TParams? ('extends' Types)? ('permits' Types)? ClassBody
 | 'enum' ID ('implements' Types)? '{' (EnumConst (',' EnumConst)*)? ','? (';' Member*)? '}'
 | 'record' ID TParams? '(' (RecParam (',' RecParam)*)? ')' ('implements' Types)? ClassBody
 | '@' 'interface' ID ClassBody ;
RecParam: Annotation* Type '...'? ID ;
EnumConst: Annotation* ID Args? ClassBody? ;
ClassBody: '{' Member* '}' ;
Mod: Annotation | 'public' | 'protected' | 'private' | 'static' | 'abstract' | 'final' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' !(':' | '->') | 'sealed' &(Mod | 'class' | 'interface' | 'sealed' | 'non') | 'non' '-' 'sealed' ;
Annotation: '@' !'interface' Qual ('(' (AnnArgs)? ')')? ;
AnnArgs: ID '=' AnnVal (',' ID '=' AnnVal)* &')' | AnnVal &')' ;
AnnVal: Annotation | '{' (AnnVal (',' AnnVal)*)? ','? '}' | Ternary ;
Member: ';' | Mod* (TypeKind | MethodOrField) | 'static'? Block ;
MethodOrField: TParams Annotation* (ID Params Throws? Block | (Type | 'void') ID Params Dims Throws? MBody)
 | ID Params Throws? Block | ID Block
 | 'void' ID Params Throws? MBody
 | Type (ID Params Dims Throws? (MBody | 'default' AnnVal ';') | Declarators ';') ;
MBody: Block | ';' ;
Throws: 'throws' Types ;
Params: '(' (Param (',' Param)*)? ')' ;
Param: PMod* Type Annotation* '...'? (ID ('.' 'this')? | 'this' | '_') Dims ;
PMod: 'final' | Annotation ;
Dims: (Annotation* '[' ']')* ;
Declarators: Declarator (',' Declarator)* ;
Declarator: (ID | '_') Dims ('=' VarInit)? ;
VarInit: ArrayInit | Expr ;
ArrayInit: '{' (VarInit (',' VarInit)*)? ','? '}' ;
Types: Type (',' Type)* ;
@Type: Annotation* (Prim | RefType) Dims ;
Prim: 'byte' | 'short' | 'int' | 'long' | 'float' | 'double' | 'char' | 'boolean' ;
RefType: ID TArgs? ('.' Annotation* ID TArgs?)* ;
@TArgs: '<' (TArg (',' TArg)*)? '>' ;
TArg: Annotation* '?' (('extends' | 'super') Type)? | Type ('&' Type)* ;
TParams: '<' TParam (',' TParam)* '>' ;
TParam: Annotation* ID ('extends' Type ('&' Type)*)? ;
@Block: '{' BlockStmt* '}' ;
BlockStmt: LocalType | LocalVar ';' | Stmt ;
LocalType: Mod* ('class' | 'interface' | 'enum' | 'record' ID ('<' | '(')) &ANY !ANY | Mod* &('class' | 'interface' | 'enum' | '@' 'interface' | 'record' ID ('<' | '(')) TypeKind ;
@LocalVar: PMod* Type (ID | '_') Dims &('=' | ',' | ';' | ':' ) ('=' VarInit)? (',' Declarator)* ;
Stmt: Block | ';'
 | 'if' '(' Expr ')' Stmt ('else' Stmt)?
 | 'while' '(' Expr ')' Stmt
 | 'do' Stmt 'while' '(' Expr ')' ';'
 | 'for' '(' (PMod* Type (ID | '_') Dims ':' Expr | (LocalVar | ExprList)? ';' Expr? ';' ExprList?) ')' Stmt
 | 'try' ('(' Resource (';' Resource)* ';'? ')' Block Catch* Finally? | Block (Catch+ Finally? | Finally))
 | SwitchBody
 | 'synchronized' '(' Expr ')' Block
 | 'return' Expr? ';' | 'throw' Expr ';' | 'break' ID? ';' | 'continue' ID? ';'
 | 'assert' Expr (':' Expr)? ';'
 | 'yield' !('=' | '.' | '++' | '--' | '(' ')' ) Expr ';'
 | ID ':' Stmt
 | ExprStmt ;
ExprStmt: ('++' | '--') Unary ';' | Postfix (AssignOp Expr | CALL) ';' ;
ExprList: Expr (',' Expr)* ;
Resource: PMod* Type (ID | '_') '=' Expr | Postfix ;
Catch: 'catch' '(' PMod* Type ('|' Type)* (ID | '_') ')' Block ;
Finally: 'finally' Block ;
SwitchBody: 'switch' '(' Expr ')' '{' SwitchItem* '}' ;
SwitchItem: Label ('->' (Block | 'throw' Expr ';' | Expr ';') | ':' BlockStmt*) ;
Label: 'default' | 'case' CaseVal (',' CaseVal)* ('when' Expr)? ;
CaseVal: 'default' | Pattern | Ternary ;
Pattern: PMod* Type ('(' (Pattern (',' Pattern)*)? ')' (ID | '_')? &('->' | ':' | ',' | 'when' | ')' | '&&' | '||' | '?' | ';') | (ID | '_') &('->' | ':' | ',' | 'when' | ')')) | '_' ;
@Expr: Lambda | Unary0 AssignOp Expr | Ternary ;
Unary0: Postfix ;
Lambda: (ID | '_') '->' LBody | '(' ((ID | '_') (',' (ID | '_'))* | Param (',' Param)*)? ')' '->' LBody ;
LBody: Block | Expr ;
AssignOp: '=' | '+=' | '-=' | '*=' | '/=' | '&=' | '|=' | '^=' | '%=' | '<<=' | '>~' '>~' '>~' '=' | '>~' '>~' '=' ;
@Ternary: Binary ('?' Expr ':' (Lambda | Ternary))? ;
Binary: Unary (BinOp (Lambda | Unary) | 'instanceof' ('final' &ANY)? (InstPattern | Type))* ;
InstPattern: PMod* Type (ID | '_') !('(' ) | PMod* Type '(' (Pattern (',' Pattern)*)? ')' ;
BinOp: '||' | '&&' | '|' | '^' | '&' | '==' | '!=' | '<=' | '>~' '=' | '<<' | '>~' '>~' '>' !'=' | '>~' '>' !'=' | '<' | '>' | '+' | '-' | '*' | '/' | '%' ;
@Unary: ('+' | '-' | '++' | '--' | '!' | '~') Unary | Cast | SwitchBody | Postfix ;
Cast: '(' Prim Dims ')' Unary | '(' Type ('&' Type)* ')' (Lambda | &('(' | '!' | '~' | ID | 'STR' | 'NUM' | 'CHAR' | 'this' | 'super' | 'new' | 'null' | 'true' | 'false' | 'switch' | 'void' | 'int' | 'long' | 'byte' | 'short' | 'double' | 'float' | 'char' | 'boolean') Unary) ;
@Postfix: Primary Suffix* ('++' | '--')* ;
Suffix: '.' (TArgs? (ID | 'super') Args? | 'this' | 'class' | 'new' Annotation* ID TArgs? Args ClassBody? | TArgs ID Args) | '[' Expr ']' | '::' TArgs? (ID | 'new') ;
Primary: 'NUM' | 'STR' | 'CHAR' | 'true' | 'false' | 'null' | 'this' Args? | 'super' (Args | &('.' | '::'))
 | 'new' Creator | '(' Expr ')' | (Prim Dims | 'void') ('.' 'class' | '::' 'new')
 | RefType Dims '::' (ID | 'new') | RefType '[' ']' ('[' ']')* '.' 'class' | ID Args? ;
Args: '(' (Expr (',' Expr)*)? ')' ;
Creator: TArgs? Annotation* (Prim | RefType) (Args ClassBody? | (Annotation* '[' ']')+ ArrayInit | (Annotation* '[' Expr ']')+ (Annotation* '[' ']')*) ;
"""

SCRIPT = r"""
Unit: Stmt* EOF ;
@Block: '{' Stmt* '}' ;
Stmt: Block | ';'
 | ('var' | 'const' !'enum' | 'let' &(ID | '[' | '{')) VarDecls EOS
 | 'await'? 'using' ~ &(ID ('=' | ':')) VarDecls EOS
 | 'function' &ANY FuncDecl
 | 'async' ~ 'function' FuncDecl
 | Decorator+ ('export' 'default'?)? TS_ABSTRACT 'class' ClassTail
 | 'class' ClassTail
 | 'import' !('(' | '.') ImportTail
 | 'export' ExportTail
 | 'if' '(' Expr ')' Stmt ('else' Stmt)?
 | 'while' '(' Expr ')' Stmt
 | 'do' Stmt 'while' '(' Expr ')' ';'?
 | 'for' 'await'? '(' ForHead ')' Stmt
 | 'switch' '(' Expr ')' '{' (('case' Expr | 'default') ':' Stmt*)* '}'
 | 'try' Block ('catch' ('(' Binding TS_ANN ')')? Block ('finally' Block)? | 'finally' Block)
 | 'return' (~ Expr)? EOS
 | 'throw' ~ Expr EOS
 | 'break' (~ ID)? EOS | 'continue' (~ ID)? EOS
 | 'debugger' EOS | 'with' '(' Expr ')' Stmt
 | TS_STMT
 | ID ':' Stmt
 | !('class' | 'function' | '{') Expr EOS ;
VarDecls: VarDecl (',' VarDecl)* ;
VarDecl: Binding TS_DEFINITE TS_ANN ('=' Assign)? ;
@Binding: ID | ObjPat | ArrPat ;
ObjPat: '{' (PatProp (',' PatProp)*)? ','? '}' ;
PatProp: '...' Binding | PropName ':' Binding ('=' Assign)? | ID ('=' Assign)? ;
ArrPat: '[' (','* ('...' Binding | Binding ('=' Assign)?) )* ','* ']' ;
ForHead: 'await'? 'using' ~ !'of' ID TS_ANN 'of' Assign | ('var' | 'const' | 'let' &(ID | '[' | '{')) Binding TS_ANN ('of' Assign | 'in' Expr) | ('var' | 'const' | 'let' &(ID | '[' | '{')) VarDecls ';' Expr? ';' Expr?
 | LHS ('of' Assign | 'in' Expr) | Expr? ';' Expr? ';' Expr? ;
FuncDecl: '*'? ID? FuncTail ;
FuncTail: TS_TPARAMS Params TS_RET (Block | TS_NOBODY) ;
FuncBody: TS_TPARAMS Params TS_RET Block ;
Params: '(' (Param (',' Param)*)? ','? ')' ;
Param: Decorator* TS_MODS ('...' Binding | Binding | 'this') TS_OPT TS_ANN ('=' Assign)? ;
Decorator: '@' ('(' Expr ')' | ID ('.' NAME)* TS_TARGS Args?) ;
ClassTail: (!'extends' !TS_IMPL ID)? TS_TPARAMS ('extends' LHS TS_TARGS)? TS_IMPLS '{' ClassMember* '}' ;
ClassMember: ';' | 'static' Block | Decorator* TS_CMODS ClassItem ;
ClassItem: TS_INDEX
 | ('get' | 'set') !('(' | '=' | ';' | '}' | ':' | '?' | '!' | '<') PropName FuncTail
 | 'async' ~ !('(' | '=' | ';' | '}' | ':' | '?' | '!' | '<') '*'? PropName TS_OPT FuncTail
 | '*' PropName FuncTail
 | PropName TS_OPT (&('(' | '<') FuncTail | TS_DEFINITE TS_ANN ('=' Assign)? EOS) ;
PropName: NAME | 'STR' | 'NUM' | 'PRIV' | '[' Assign ']' ;
ImportTail: TS_TYPE_KW ('STR' | ImportClause 'from' 'STR') Attributes EOS | TS_IMPORT_EQ ;
Attributes: ('with' '{' (ImportAttr (',' ImportAttr)*)? ','? '}')? ;
ImportAttr: (NAME | 'STR') ':' 'STR' ;
ImportClause: ID (',' (NamedImports | '*' 'as' ID))? | '*' 'as' ID | NamedImports ;
NamedImports: '{' (Spec (',' Spec)*)? ','? '}' ;
Spec: 'type' NAME &(',' | '}' | 'as') ('as' NAME)? | (NAME | 'STR') ('as' (NAME | 'STR'))? ;
ExportTail: 'default' (TS_ABSTRACT 'class' ClassTail | 'function' FuncDecl | 'async' ~ 'function' FuncDecl | TS_DEFAULT | Assign EOS)
 | '*' ('as' (NAME | 'STR'))? 'from' 'STR' Attributes EOS
 | TS_TYPE_KW NamedImports ('from' 'STR' Attributes)? EOS
 | TS_EXPORT
 | &('var' | 'let' | 'const' | 'function' | 'async' | 'class' | '@') Stmt ;
@Expr: Assign (',' Assign)* ;
@Assign: Yield | Arrow | LHS AssignOp Assign | Cond ;
Yield: 'yield' !('=' | '.' | ')' ':' ) (~ '*' Assign | ~ Assign)? &(';' | ')' | '}' | ']' | ',' | 'EOF' | ANY) ;
@Arrow: 'async' ~ (ID ~ '=>' ArrowBody | TS_TPARAMS Params TS_RET ~ '=>' ArrowBody) | ID ~ '=>' ArrowBody | TS_TPARAMS Params TS_RET ~ '=>' ArrowBody ;
ArrowBody: Block | !'{' Assign ;
AssignOp: '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??=' | '>~' '>~' '>~' '=' | '>~' '>~' '=' ;
@Cond: Binary ('?' Assign ':' Assign)? ;
Binary: Unary (BinOp Unary | TS_AS)* | 'PRIV' 'in' Unary (BinOp Unary)* ;
BinOp: '||' | '&&' | '??' | '|' | '^' | '&' | '===' | '!==' | '==' | '!=' | '<=' | '>~' '=' | '<<' | '>~' '>~' '>' !'=' | '>~' '>' !'=' | '<' | '>' | 'instanceof' | 'in' | '+' | '-' | '**' | '*' | '/' | '%' ;
@Unary: ('delete' | 'void' | 'typeof' | '+' | '-' | '~T' | '!') Unary | 'await' !('=' | '.' | ')' | ',' | ';' | '=>' | '?' | ':' | '(' ')' ) Unary | ('++' | '--') Unary | TS_CAST | LHS (~ ('++' | '--'))? ;
@LHS: (NewExpr | 'import' ('(' Assign (',' Assign)? ','? ')' | '.' ID) | 'super' &('(' | '.' | '[') | Primary) Suffix* ;
NewExpr: 'new' ('.' ID | (NewExpr | Primary) NewSuffix* TS_TARGS Args?) ;
NewSuffix: '.' (NAME | 'PRIV') | '[' Expr ']' ;
Suffix: TS_BANG | '.' (NAME | 'PRIV') | '?.' (Args | '[' Expr ']' | TS_CALLARGS | NAME | 'PRIV') | '[' Expr ']' | Args | Template | TS_CALLARGS ;
Args: '(' (Arg (',' Arg)*)? ','? ')' ;
Arg: '...' Assign | Assign ;
Template: 'TEMPLATE' | 'THEAD' Expr ('TMID' Expr)* 'TTAIL' ;
Primary: 'this' | 'null' | 'true' | 'false' | 'NUM' | 'STR' | 'REGEX' | Template
 | '[' (','* Arg)? (','+ Arg)* ','* ']' | '{' (Prop (',' Prop)*)? ','? '}'
 | Decorator* 'class' ClassTail | 'function' '*'? ID? FuncBody | 'async' ~ 'function' '*'? ID? FuncBody
 | '(' Expr ')' | Jsx | ID ;
Prop: '...' Assign
 | ('get' | 'set') !('(' | ',' | ':' | '}' | '=') PropName FuncBody
 | 'async' ~ !('(' | ',' | ':' | '}' | '=') '*'? PropName FuncBody
 | '*' PropName FuncBody
 | PropName (':' Assign | &('(' | '<') FuncBody)
 | ID ('=' Assign)? ;
Jsx: 'JSXOPEN' (JsxName JsxAttr* ('JSXSELF' | 'JSXGT' JsxKid* 'JSXCLOSE' JsxName 'JSXEND') | 'JSXGT' JsxKid* 'JSXCLOSE' 'JSXEND') ;
JsxName: 'JSXNAME' ((':' | '.') 'JSXNAME')* ;
JsxAttr: '{' '...' Assign '}' | 'JSXNAME' (':' 'JSXNAME')? ('=' ('STR' | '{' Assign '}' | Jsx))? ;
JsxKid: 'TEXT' | '{' ('...' Assign | Expr)? '}' | Jsx ;
"""

# what the hooks of SCRIPT stand for in plain JavaScript, and in TypeScript
HOOKS_JS = r"""
TS_ABSTRACT: ; TS_ANN: ; TS_DEFINITE: ; TS_STMT: !ANY ANY ; TS_TPARAMS: ; TS_RET: ; TS_NOBODY: !ANY ANY ; TS_MODS: ; TS_OPT: ; TS_TARGS: ;
TS_IMPL: !ANY ANY ; TS_IMPLS: ; TS_CMODS: ('static' !('(' | '=' | ';' | '}'))? ('accessor' ~ &(NAME | 'PRIV' | '[' | 'STR'))? ; TS_INDEX: !ANY ANY ; TS_TYPE_KW: ; TS_IMPORT_EQ: !ANY ANY ; TS_DEFAULT: !ANY ANY ;
TS_EXPORT: !ANY ANY ; TS_AS: !ANY ANY ; TS_CAST: !ANY ANY ; TS_BANG: !ANY ANY ; TS_CALLARGS: !ANY ANY ;
"""
HOOKS_TS = r"""
TS_ABSTRACT: 'abstract'? ; TS_ANN: (':' Type)? ; TS_DEFINITE: ('!' &':')? ; TS_TPARAMS: TParams? ; TS_RET: (':' RetType)? ; TS_NOBODY: EOS ;
TS_MODS: (('public' | 'private' | 'protected' | 'readonly' | 'override') &(ID | '{' | '[' | '...'))* ; TS_OPT: '?'? ('!' &':')? ; TS_TARGS: TArgs? ;
TS_IMPL: 'implements' ; TS_IMPLS: ('implements' Type (',' Type)*)? ;
TS_CMODS: (('static' | 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'override' | 'declare' | 'accessor') !('(' | '=' | ';' | '}' | ':' | '?' | '!' | '<' | ','))* ;
TS_INDEX: '[' ID ':' Type ']' (':' Type)? EOS ;
TS_TYPE_KW: ('type' !('from' 'STR') &('{' | '*' | ID))? ;
TS_IMPORT_EQ: 'type'? ID '=' ('require' '(' 'STR' ')' | ID ('.' NAME)*) EOS ;
TS_DEFAULT: Interface ;
TS_EXPORT: TS_STMT | '=' Assign EOS | 'as' 'namespace' ID EOS | 'import' ID '=' ('require' '(' 'STR' ')' | ID ('.' NAME)*) EOS ;
TS_STMT: 'abstract' ~ 'class' ClassTail | Interface | 'type' ~ ID TParams? '=' Type EOS | 'const'? 'enum' ID EnumBody
 | ('namespace' | 'module') ~ (ID ('.' NAME)* | 'STR') (Block | EOS) | 'declare' ~ 'global' Block | 'global' Block
 | 'declare' ~ &('var' | 'let' | 'const' | 'function' | 'async' | 'class' | 'abstract' | 'interface' | 'type' | 'enum' | 'namespace' | 'module') Stmt ;
Interface: 'interface' ~ ID TParams? ('extends' Type (',' Type)*)? ObjType ;
EnumBody: '{' (PropName ('=' Assign)? (',' PropName ('=' Assign)?)*)? ','? '}' ;
TS_AS: ~ ('as' | 'satisfies') ('const' | Type) ;
TS_CAST: '<' ('const' | Type) '>' Unary ;
TS_BANG: ~ '!' ;
TS_CALLARGS: TArgs &('(' | 'TEMPLATE' | 'THEAD') (Args | Template) | TArgs !(ID | 'STR' | 'NUM' | '{' | '[' | 'this' | 'new' | '+' | '-') ;
TParams: '<' TParam (',' TParam)* ','? '>' ;
TParam: ('const' | 'in' | 'out')* ID ('extends' Type)? ('=' Type)? ;
@TArgs: '<' Type (',' Type)* '>' ;
RetType: 'asserts' ~ (ID | 'this') ('is' Type)? | (ID | 'this') ~ 'is' Type | Type ;
@Type: FuncType | Union (~ 'extends' Union '?' Type ':' Type)? ;
FuncType: 'abstract'? 'new' TParams? Params '=>' Type | TParams Params '=>' RetType | &'(' Params '=>' RetType ;
Union: '|'? Inter ('|' Inter)* ;
Inter: '&'? TypeOp ('&' TypeOp)* ;
TypeOp: ('keyof' | 'unique' | 'readonly') &(NAME | '(' | '[' | '{' | 'STR') TypeOp | 'infer' ID ('extends' Union !'?')? | PostType ;
PostType: PrimType (~ '[' Type? ']' | ~ '!' )* ;
PrimType: '(' Type ')' | MappedType | ObjType | '[' (TupleItem (',' TupleItem)*)? ','? ']' | 'STR' | '-'? 'NUM' | 'TEMPLATE' | 'THEAD' Type ('TMID' Type)* 'TTAIL'
 | 'typeof' ('import' '(' 'STR' ')' | ID | 'this') ('.' (NAME | 'PRIV'))* (~ TArgs)? | 'import' '(' 'STR' (',' ANYOBJ)? ')' ('.' NAME)* TArgs? | 'this' | 'void' | 'null' | 'true' | 'false' | ID ('.' NAME)* (~ TArgs)? ;
ANYOBJ: '{' (PropName ':' Assign) '}' ;
TupleItem: '...'? NAME '?'? ':' Type | '...' Type | Type '?'? ;
MappedType: '{' (('+' | '-')? 'readonly')? '[' ID 'in' Type ('as' Type)? ']' (('+' | '-')? '?')? (':' Type)? (';' | ',')? '}' ;
ObjType: '{' (TypeMember)* '}' ;
TypeMember: TypeItem (';' | ',' | &'}' | NEWLINE) ;
TypeItem: ('readonly' !('(' | '?' | ':' | ';' | ',' | '}' | '<'))? TypeItem1 ;
TypeItem1: 'new' TParams? Params (':' Type)? | TParams? Params (':' RetType)? | '[' ID ':' Type ']' ':' Type
 | ('get' | 'set') !('(' | '?' | ':' | ';' | ',' | '}' | '<') PropName Params (':' Type)? | PropName '?'? (&('(' | '<') TParams? Params (':' RetType)? | (':' Type)?) ;
"""

LEX = re.compile(r"\s+|'([^']*)'|([A-Za-z_][A-Za-z_0-9]*)|([:;|*+?()!&~@])")
WORD = re.compile(r"[A-Za-z_$]")


def _read(text: str) -> tuple[dict, set]:
    """Rules of a grammar: name -> tree."""
    toks = []
    at = 0
    while at < len(text):
        m = LEX.match(text, at)
        if m is None:
            raise ValueError(text[at : at + 30])
        at = m.end()
        if m.group(1) is not None:
            toks.append(("t", m.group(1)))
        elif m.group(2):
            toks.append(("n", m.group(2)))
        elif m.group(3):
            toks.append((m.group(3), ""))
    rules, memo, i = {}, set(), 0

    def alts():
        nonlocal i
        out = [seq()]
        while toks[i][0] == "|":
            i += 1
            out.append(seq())
        return out[0] if len(out) == 1 else ("alt", out)

    def seq():
        nonlocal i
        out = []
        while toks[i][0] not in ("|", ")", ";"):
            out.append(item())
        return ("seq", out)

    def item():
        nonlocal i
        k, v = toks[i]
        i += 1
        if k in "!&":
            return ("not" if k == "!" else "and", item())
        if k == "~":
            return ("same",)
        if k == "(":
            x = alts()
            i += 1
        else:
            x = ("term", v) if k == "t" else ("ref", v)
        while toks[i][0] in ("*", "+", "?"):
            x = ({"*": "many", "+": "some", "?": "opt"}[toks[i][0]], x)
            i += 1
        return x

    while i < len(toks):
        keep = toks[i][0] == "@"
        i += keep
        name = toks[i][1]
        i += 2
        rules[name] = alts()
        i += 1
        if keep:
            memo.add(name)
    return rules, memo


ONE, SET, CALL, RET, ALT, COMMIT, SKIP, TRY, LOOP, NOT, NOTEND, AND, ANDEND, EOS, EOF, ANY, NEWLINE, CALLED, SAME, KEEP, KEPT, ACCEPT = range(22)


class Parser:
    """Tables of one grammar. ``parse`` gives the index of the first token that no derivation can take, or -1."""

    def __init__(self, text: str, context: frozenset[str], reserved: frozenset[str]):
        self.rules, self.memo = _read(text)
        self.sets = {"ID": frozenset(context | {"ID"}), "NAME": frozenset(context | {x for x in reserved if WORD.match(x)} | {"ID"})}
        self.first: dict = {r: frozenset() for r in self.rules}
        self.empty: dict = dict.fromkeys(self.rules, False)
        changed = True
        while changed:  # FIRST sets and emptiness, to a fixed point
            changed = False
            for r, t in self.rules.items():
                f, e = self._first(t)
                if f - self.first[r] or e != self.empty[r]:
                    self.first[r] |= f
                    self.empty[r] = self.empty[r] or e
                    changed = True
        self.op: list[int] = []
        self.arg: list = []
        self.at: dict[str, int] = {}
        self._put(CALL, "Unit")
        self._put(ACCEPT, None)
        for r, t in self.rules.items():
            self.at[r] = len(self.op)
            if r in self.memo:
                self._put(KEEP, r)
            self._compile(t)
            self._put(KEPT if r in self.memo else RET, None)
        self.arg = [self.at[a] if o == CALL else a for o, a in zip(self.op, self.arg, strict=True)]

    def _put(self, op: int, arg) -> int:
        self.op.append(op)
        self.arg.append(arg)
        return len(self.op) - 1

    def _accepts(self, v: str) -> frozenset[str]:
        return frozenset({">", ">~"}) if v == ">" else frozenset({"~"}) if v == "~T" else frozenset({v})

    def _first(self, t) -> tuple[frozenset, bool]:
        k = t[0]
        if k == "term":
            return self._accepts(t[1]), False
        if k == "ref":
            v = t[1]
            if v in self.sets:
                return self.sets[v], False
            if v == "EOS":
                return frozenset({";"}), True
            if v in ("CALL", "NEWLINE"):
                return frozenset(), True
            if v == "EOF":
                return frozenset({"EOF"}), False
            if v == "ANY":
                return frozenset({"\0any"}), False
            return self.first[v], self.empty[v]
        if k in ("not", "and", "same"):
            return frozenset(), True
        if k == "alt":
            fs = [self._first(x) for x in t[1]]
            return frozenset().union(*[f for f, _ in fs]), any(e for _, e in fs)
        if k == "seq":
            out: frozenset = frozenset()
            for x in t[1]:
                f, e = self._first(x)
                out |= f
                if not e:
                    return out, False
            return out, True
        f, e = self._first(t[1])
        return f, e or k != "some"

    def _compile(self, t) -> None:
        k = t[0]
        if k == "term" or (k == "ref" and t[1] in self.sets):
            acc = self._accepts(t[1]) if k == "term" else self.sets[t[1]]
            self._put(*((ONE, next(iter(acc))) if len(acc) == 1 else (SET, acc)))
        elif k == "ref":
            special = {"EOF": EOF, "ANY": ANY, "EOS": EOS, "NEWLINE": NEWLINE, "CALL": CALLED}
            self._put(special.get(t[1], CALL), t[1])
        elif k == "same":
            self._put(SAME, None)
        elif k in ("not", "and"):
            start = self._put(NOT if k == "not" else AND, None)
            self._compile(t[1])
            self._put(NOTEND if k == "not" else ANDEND, None)
            self.arg[start] = len(self.op)
        elif k == "seq":
            for x in t[1]:
                self._compile(x)
        elif k == "alt":
            start = self._put(ALT, None)
            infos, ends = [], []
            for x in t[1]:
                infos.append((len(self.op), *self._first(x)))
                self._compile(x)
                ends.append(self._put(COMMIT, None))
            for e in ends:
                self.arg[e] = len(self.op)
            types = frozenset().union(*[f for _, f, _ in infos])
            table = {c: tuple(pc for pc, fs, e in infos if c in fs or e or "\0any" in fs) for c in types}
            self.arg[start] = (table, tuple(pc for pc, fs, e in infos if e or "\0any" in fs))
        else:
            if k == "some":
                self._compile(t[1])
            fs, e = self._first(t[1])
            test = None if e or "\0any" in fs else self._put(SKIP, None)
            start = self._put(TRY, None)
            self._compile(t[1])
            end = self._put(COMMIT if k == "opt" else LOOP, None)
            after = len(self.op)
            self.arg[start] = after
            self.arg[end] = after if k == "opt" else (start if test is None else test, after)
            if test is not None:
                self.arg[test] = (fs, after)

    def parse(self, tokens: L.Tokens) -> int:
        op, arg, T, nl = self.op, self.arg, tokens, tokens.nl
        calls: list = []  # where open rules go on
        backs: list = []  # [position, open rules, what to do on failure, its state]
        memo: dict = {}
        pc = i = far = 0
        while True:
            o = op[pc]
            ok = True
            if o == ONE:
                if T[i] == arg[pc]:
                    i += 1
                    pc += 1
                    continue
                ok = False
            elif o == SKIP:
                fs, after = arg[pc]
                pc = pc + 1 if T[i] in fs else after
                continue
            elif o == CALL:
                calls.append(pc + 1)
                pc = arg[pc]
                continue
            elif o == RET:
                pc = calls.pop()
                continue
            elif o == ALT:
                table, anyway = arg[pc]
                ways = table.get(T[i], anyway)
                if ways:
                    backs.append((i, len(calls), ALT, ways, 1))
                    pc = ways[0]
                    continue
                ok = False
            elif o == COMMIT:
                backs.pop()
                pc = arg[pc]
                continue
            elif o == KEEP:
                key = (pc, i)
                j = memo.get(key)
                if j is None:
                    backs.append((i, len(calls), KEEP, key, 0))
                    pc += 1
                    continue
                if j >= 0:
                    i = j
                    pc = calls.pop()
                    continue
                ok = None  # known to fail here
            elif o == KEPT:
                memo[backs.pop()[3]] = i
                pc = calls.pop()
                continue
            elif o == SET:
                if T[i] in arg[pc]:
                    i += 1
                    pc += 1
                    continue
                ok = False
            elif o == TRY:
                backs.append((i, len(calls), TRY, arg[pc], 0))
                pc += 1
                continue
            elif o == LOOP:
                again, after = arg[pc]
                pc = after if backs.pop()[0] == i else again
                continue
            elif o == NOT or o == AND:
                backs.append((i, len(calls), o, arg[pc], far))
                pc += 1
                continue
            elif o == ANDEND:
                i, _, _, _, far = backs.pop()
                pc += 1
                continue
            elif o == NOTEND:
                far = backs.pop()[4]
                ok = None
            elif o == SAME:
                if not nl[i]:
                    pc += 1
                    continue
                ok = None
            elif o == EOS:
                x = T[i]
                if x == ";":
                    i += 1
                    pc += 1
                    continue
                if x == "}" or x == "EOF" or nl[i]:
                    pc += 1
                    continue
                ok = False
            elif o == EOF:
                if T[i] == "EOF":
                    pc += 1
                    continue
                ok = False
            elif o == ANY:
                if T[i] != "EOF":
                    i += 1
                    pc += 1
                    continue
                ok = None
            elif o == NEWLINE:
                if nl[i]:
                    pc += 1
                    continue
                ok = False
            elif o == CALLED:
                if T[i - 1] in (")", "}", "++", "--"):
                    pc += 1
                    continue
                ok = False
            elif o == ACCEPT:
                return -1
            # failure: back to the last place with another way
            if ok is False and i > far:
                far = i
            while True:
                if not backs:
                    return far
                i, depth, what, state, n = backs.pop()
                if what == ALT:
                    if n < len(state):
                        backs.append((i, depth, ALT, state, n + 1))
                        pc = state[n]
                        break
                    if i > far:
                        far = i
                elif what == TRY:
                    pc = state
                    break
                elif what == KEEP:
                    memo[state] = -1
                elif what == NOT:
                    far = n
                    pc = state
                    break
                else:
                    far = n
            del calls[depth:]


@lru_cache(maxsize=None)
def parser(kind: str) -> Parser:
    if kind == "java":
        return Parser(JAVA, L.JAVA_CONTEXT, L.JAVA_RESERVED)
    if kind == "jsx":
        return Parser(SCRIPT + HOOKS_JS, L.JS_CONTEXT, L.JS_RESERVED)
    return Parser(SCRIPT + HOOKS_TS, L.TS_CONTEXT, L.JS_RESERVED)
