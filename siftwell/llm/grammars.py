"""Grammars of the dialects, run by ``gll``. Statement forms follow the language references; operator
precedence is left out where it decides on trees and not on membership. A text is a file, or members of a
class body; both start rules run together in one graph-structured stack."""

from __future__ import annotations

import re
from functools import cache

from siftwell.llm.gll import Grammar

#: Parts of rules, written out in each so that one automaton decides without a call: places that can be assigned to
#: (a name, a member, an element), calls, and what is neither.
_JAVA_PARTS = {
    "prefixed": "( '+' | '-' | '++' | '--' | '!' | '~' ) unary | '(' type ( '&' type )* ')' ( unary | lambda )",
    "any": "( @name@ | @other@ | @call@ ) ( @place@ | @sent@ | @rest@ )*",
    "name": "( NAME | '(' expr ')' )",
    "call": "( NAME args | ( 'this' | 'super' ) args | 'new' creator )",
    "other": "( LIT | 'true' | 'false' | 'null' | 'this' | 'super' | primitive dims? '.' 'class' | 'void' '.' 'class' | primitive dims '::' 'new' )",
    "place": "( '.' NAME | '[' expr ']' )",
    "sent": "( '.' type_args? ( NAME | 'yield' ) args | '.' 'super' args | '.' 'new' creator )",
    "rest": "( '.' ( 'this' | 'class' | 'super' ) | '::' type_args? ( NAME | 'new' ) | dims ( '.' 'class' | '::' type_args? ( NAME | 'new' ) ) | type_args ( '.' NAME type_args? )* dims? '::' type_args? ( NAME | 'new' ) )",
}

JAVA = r"""
unit = package? import* ( type_decl | ';' )* | member+ ;
package = annotation* 'package' qname ';' ;
import = 'import' 'static'? qname ( '.' '*' )? ';' ;
qname = NAME ( '.' NAME )* ;
annotation = '@' qname ( '(' ( annotation_value ( ',' annotation_value )* )? ')' )? ;
annotation_value = ( NAME '=' )? ( expr | annotation | '{' ( annotation_value ( ',' annotation_value )* ','? )? '}' ) ;
mod = annotation | 'public' | 'protected' | 'private' | 'static' | 'abstract' | 'final' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non' '-' 'sealed' ;
type_decl = mod* ( class_decl | interface_decl | enum_decl | record_decl | annotation_decl ) ;
class_decl = 'class' NAME type_params? ( 'extends' type )? ( 'implements' types )? ( 'permits' types )? class_body ;
interface_decl = 'interface' NAME type_params? ( 'extends' types )? ( 'permits' types )? class_body ;
annotation_decl = '@' 'interface' NAME class_body ;
enum_decl = 'enum' NAME ( 'implements' types )? '{' ( constant ( ',' constant )* )? ','? ( ';' member* )? '}' ;
constant = annotation* NAME args? class_body? ;
record_decl = 'record' NAME type_params? '(' params? ')' ( 'implements' types )? class_body ;
class_body = '{' member* '}' ;
member = ';' | type_decl | mod* ( type_params? ( result NAME '(' params? ')' dims? throws? ( block | ( 'default' annotation_value )? ';' ) | NAME '(' params? ')' throws? block ) | type declarator ( ',' declarator )* ';' | NAME block ) | 'static'? block ;
result = type | annotation* 'void' ;
throws = 'throws' types ;
types = type ( ',' type )* ;
type_params = '<' type_param ( ',' type_param )* close ;
type_param = annotation* NAME ( 'extends' type ( '&' type )* )? ;
close = '>' | '>a' ;
type = annotation* ( primitive | class_type ) dims? ;
primitive = 'boolean' | 'byte' | 'short' | 'int' | 'long' | 'char' | 'float' | 'double' ;
class_type = NAME type_args? ( '.' annotation* NAME type_args? )* ;
type_args = '<' ( type_arg ( ',' type_arg )* )? close ;
type_arg = type | annotation* '?' ( ( 'extends' | 'super' ) type )? ;
dims = ( annotation* '[' ']' )+ ;
params = param ( ',' param )* ;
param = ( annotation | 'final' )* type ( annotation* '...' )? ( NAME | ( NAME '.' )* 'this' ) dims? ;
declarator = NAME dims? ( '=' initial )? ;
initial = expr | array_init ;
array_init = '{' ( initial ( ',' initial )* )? ','? '}' ;
block = '{' block_statement* '}' ;
block_statement = local ';' | type_decl | statement ;
local = ( 'final' | annotation )* type declarator ( ',' declarator )* ;
statement = block | ';' | effect ';' | NAME ':' statement | 'if' '(' expr ')' statement ( 'else' statement )? | 'while' '(' expr ')' statement | 'do' statement 'while' '(' expr ')' ';'
  | 'for' '(' ( local | effect ( ',' effect )* )? ';' expr? ';' ( effect ( ',' effect )* )? ')' statement | 'for' '(' ( 'final' | annotation )* type NAME dims? ':' expr ')' statement
  | 'return' expr? ';' | 'throw' expr ';' | ( 'break' | 'continue' ) NAME? ';' | 'assert' expr ( ':' expr )? ';' | 'synchronized' '(' expr ')' block | switch | 'yield' expr ';'
  | 'try' block ( catch+ finally? | finally ) | 'try' '(' resource ( ';' resource )* ';'? ')' block catch* finally? ;
catch = 'catch' '(' ( 'final' | annotation )* type ( '|' type )* NAME ')' block ;
finally = 'finally' block ;
resource = local | unary ;
switch = 'switch' '(' expr ')' '{' ( label ':' block_statement* )* '}' | 'switch' '(' expr ')' '{' ( label '->' ( expr ';' | block | 'throw' expr ';' ) )* '}' ;
label = 'case' ( case_item ( ',' case_item )* ) ( 'when' expr )? | 'default' ;
case_item = expr | pattern | 'default' ;
pattern = ( 'final' | annotation )* type NAME? | type '(' ( pattern ( ',' pattern )* )? ')' NAME? ;
effect = ( '++' | '--' ) unary | ( @name@ | @any@ @place@ ) ( '++' | '--' | assign expr ) | @call@ | @any@ @sent@ ;
assign = '=' | '+=' | '-=' | '*=' | '/=' | '&=' | '|=' | '^=' | '%=' | '<<=' | '>a' '>=' | '>a' '>a' '>=' ;
expr = lambda | ( @name@ | @any@ @place@ ) assign expr | ( @prefixed@ | @any@ ( '++' | '--' )* | switch ) ( binary lambda | ( binary unary | 'instanceof' pattern )* ( '?' expr ':' expr )? ) ;
lambda = ( NAME | '(' ( lambda_param ( ',' lambda_param )* )? ')' ) '->' ( expr | block ) ;
lambda_param = NAME | param ;
binary = '||' | '&&' | '|' | '^' | '&' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<<' | '>a' '>' | '>a' '>a' '>' | '+' | '-' | '*' | '/' | '%' ;
unary = @prefixed@ | @any@ ( '++' | '--' )* | switch ;
creator = annotation* type_args? ( primitive | class_type ) ( args class_body? | ( annotation* '[' expr ']' )+ dims? | dims array_init ) ;
args = '(' ( expr ( ',' expr )* )? ')' ;
"""

#: Parameters without a default stand before those with one; after a keyword argument none stands by its place.
_PYTHON_PARTS = {
    "plain": "name ( ':' test )?",
    "given": "name ( ':' test )? '=' test",
    "star": "( ( '*' name ( ':' '*'? test )? ( ',' name ( ':' test )? ( '=' test )? )* | '*' ( ',' name ( ':' test )? ( '=' test )? )+ ) ( ',' '**' name ( ':' test )? )? | '**' name ( ':' test )? )",
    "given_name": "name '=' test",
    "star_name": "( ( '*' name ( ',' name ( '=' test )? )* | '*' ( ',' name ( '=' test )? )+ ) ( ',' '**' name )? | '**' name )",
    "position": "( '*' test | named comprehension? )",
    "keyword": "name '=' test",
}

PYTHON = r"""
file = statement* ;
statement = simple | compound ;
simple = small ( ';' small )* ';'? NEWLINE ;
small = rest | tgt ( ':' test ( '=' rest )? | augment rest | ( ',' tgt )* ','? ( '=' tlist )* '=' rest ) | 'pass' | 'break' | 'continue' | 'return' items? | 'raise' ( test ( 'from' test )? )? | 'global' names | 'nonlocal' names | 'del' targets | 'assert' test ( ',' test )? | import | 'type' name type_params? '=' test ;
tlist = tgt ( ',' tgt )* ','? ;
tgt = '*'? ( name | '(' tlist? ')' | '[' tlist? ']' | 'await'? atom ( '.' name | '(' arguments? ')' | '[' subscripts ']' )* ( '.' name | '[' subscripts ']' ) ) ;
names = name ( ',' name )* ;
name = NAME | 'match' | 'case' | 'type' ;
rest = 'yield' ( 'from' test | items )? | items ;
augment = '+=' | '-=' | '*=' | '@=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '**=' | '//=' ;
targets = tgt ( ',' tgt )* ','? ;
import = 'import' dotted ( 'as' name )? ( ',' dotted ( 'as' name )? )* | 'from' ( '.' | '...' )* dotted 'import' imported | 'from' ( '.' | '...' )+ 'import' imported ;
imported = '*' | '(' import_as ( ',' import_as )* ','? ')' | import_as ( ',' import_as )* ;
import_as = name ( 'as' name )? ;
dotted = name ( '.' name )* ;
compound = decorator* ( function | class ) | 'if' named ':' suite ( 'elif' named ':' suite )* ( 'else' ':' suite )? | 'while' named ':' suite ( 'else' ':' suite )? | 'async'? 'for' items_target 'in' items ':' suite ( 'else' ':' suite )?
  | 'try' ':' suite ( ( 'except' '*'? ( items ( 'as' name )? )? ':' suite )+ ( 'else' ':' suite )? ( 'finally' ':' suite )? | 'finally' ':' suite ) | 'async'? 'with' with_items ':' suite | 'match' items ':' NEWLINE INDENT match_case+ DEDENT ;
items_target = star_target ( ',' star_target )* ','? ;
star_target = '*'? atom_chain ;
with_items = with_item ( ',' with_item )* | '(' with_item ( ',' with_item )* ','? ')' ;
with_item = test ( 'as' star_target )? ;
decorator = '@' named NEWLINE ;
function = 'async'? 'def' name type_params? '(' params? ')' ( '->' items )? ':' suite ;
class = 'class' name type_params? ( '(' arguments? ')' )? ':' suite ;
type_params = '[' type_param ( ',' type_param )* ','? ']' ;
type_param = ( '*' | '**' )? name ( ':' test )? ( '=' test )? ;
params = ( @plain@ ( ',' @plain@ )* ( ',' '/' ( ',' @plain@ )* )? ( ',' @given@ ( ',' @given@ )* ( ',' '/' ( ',' @given@ )* )? )? ( ',' @star@ )? | @given@ ( ',' @given@ )* ( ',' '/' ( ',' @given@ )* )? ( ',' @star@ )? | @star@ ) ','? ;
suite = simple | NEWLINE INDENT statement+ DEDENT ;
match_case = 'case' case_patterns ( 'if' named )? ':' suite ;
case_patterns = case_pattern ( ',' case_pattern )* ','? ;
case_pattern = '*' name | case_or ( 'as' name )? ;
case_or = case_closed ( '|' case_closed )* ;
case_closed = '-'? NUM ( ( '+' | '-' ) NUM )? | STR+ | 'None' | 'True' | 'False' | dotted | dotted '(' ( case_arg ( ',' case_arg )* ','? )? ')' | '(' case_patterns? ')' | '[' case_patterns? ']' | '{' ( case_entry ( ',' case_entry )* ','? )? '}' ;
case_arg = ( name '=' )? case_pattern ;
case_entry = '**' name | ( '-'? NUM | STR+ | 'None' | 'True' | 'False' | dotted ) ':' case_pattern ;
items = item ( ',' item )* ','? ;
item = '*' test | named ;
named = name ':=' test | test ;
test = disjunction ( 'if' disjunction 'else' test )? | 'lambda' lambda_params? ':' test ;
lambda_params = ( name ( ',' name )* ( ',' '/' ( ',' name )* )? ( ',' @given_name@ ( ',' @given_name@ )* ( ',' '/' ( ',' @given_name@ )* )? )? ( ',' @star_name@ )? | @given_name@ ( ',' @given_name@ )* ( ',' '/' ( ',' @given_name@ )* )? ( ',' @star_name@ )? | @star_name@ ) ','? ;
disjunction = negation ( ( 'or' | 'and' ) negation )* ;
negation = 'not'* comparison ;
comparison = operand ( ( '<' | '>' | '==' | '>=' | '<=' | '!=' | 'in' | 'not' 'in' | 'is' | 'is' 'not' ) operand )* ;
operand = ( '+' | '-' | '~' )* atom_chain ( ( '|' | '^' | '&' | '<<' | '>>' | '+' | '-' | '*' | '/' | '%' | '//' | '@' | '**' ) ( '+' | '-' | '~' )* atom_chain )* ;
atom_chain = 'await'? atom ( '.' name | '(' arguments? ')' | '[' subscripts ']' )* ;
atom = name | NUM | STR+ | '...' | 'None' | 'True' | 'False' | '(' ( 'yield' ( 'from' test | items )? | items | named comprehension )? ')' | '[' ( items | named comprehension )? ']' | '{' ( entries | items | named comprehension | test ':' test comprehension )? '}' ;
entries = entry ( ',' entry )* ','? ;
entry = test ':' test | '**' operand ;
comprehension = ( 'async'? 'for' items_target 'in' disjunction ( 'if' condition )* )+ ;
condition = name ':=' disjunction | disjunction ( 'if' disjunction 'else' test )? | 'lambda' lambda_params? ':' test ;
arguments = ( @position@ ( ',' @position@ )* ( ',' @keyword@ ( ',' ( @keyword@ | '*' test ) )* )? ( ',' '**' test ( ',' ( '**' test | @keyword@ ) )* )? | @keyword@ ( ',' ( @keyword@ | '*' test ) )* ( ',' '**' test ( ',' ( '**' test | @keyword@ ) )* )? | '**' test ( ',' ( '**' test | @keyword@ ) )* ) ','? ;
subscripts = subscript ( ',' subscript )* ','? ;
subscript = '*' test | named | test? ':' test? ( ':' test? )? ;
"""

#: Parts of rules written out in each: what can be assigned to, what follows it, and an operand without a sign before it.
_SCRIPT_PARTS = {
    "plain": "@cast@ ( @target@ | @value@ ) ( @access@ | @sent@ )* ( '++' | '--' )? @as_types@",
    "target": "( id | '(' expr ')' | array | object )",
    "value": "( LIT | template | 'this' | 'super' | 'null' | 'true' | 'false' | function | class | 'new' 'new'* ( id | 'this' | 'super' | '(' expr ')' | class | function | array | object | 'import' '.' name ) new_suffix* @type_args@ args? | 'new' '.' name | 'import' ( '.' name | '(' one ( ',' one )? ','? ')' ) )",
    "access": "( '.' ( name | PRIVATE ) | '[' expr ']' @suffix_more@ )",
    "sent": "( '?.' ( name | PRIVATE | '[' expr ']' | @type_args@ args ) | @type_args@ args | template )",
}

#: Shared by both script dialects; @name@ marks parts, and where types may stand.
_SCRIPT = r"""
program = item* | member+ ;
item = statement | import | export ;
import = 'import' @type_only@ ( LIT | ( binding_list 'from' LIT ) ) ( 'with' object )? end | @import_equals@ ;
binding_list = id ( ',' ( '*' 'as' id | named_imports ) )? | '*' 'as' id | named_imports ;
named_imports = '{' ( specifier ( ',' specifier )* ','? )? '}' ;
specifier = @type_only@ ( name | LIT ) ( 'as' ( name | LIT ) )? ;
export = 'export' ( @type_only@ ( '*' ( 'as' ( name | LIT ) )? 'from' LIT | named_imports ( 'from' LIT )? ) end | 'default' ( function | class | expr end @default_more@ ) | declaration @export_more@ ) ;
declaration = function | class | variable end @declaration_more@ ;
end = ';' | ~ ;
id = NAME | 'as' | 'async' | 'from' | 'get' | 'of' | 'set' | 'let' | 'static' | 'yield' | 'await' @more_ids@ ;
name = id | 'break' | 'case' | 'catch' | 'class' | 'const' | 'continue' | 'debugger' | 'default' | 'delete' | 'do' | 'else' | 'enum' | 'export' | 'extends' | 'false' | 'finally' | 'for' | 'function' | 'if' | 'import' | 'in' | 'instanceof' | 'new' | 'null' | 'return' | 'super' | 'switch' | 'this' | 'throw' | 'true' | 'try' | 'typeof' | 'var' | 'void' | 'while' | 'with' ;
statement = block | ';' | declaration | expr end | 'if' '(' expr ')' statement ( 'else' statement )? | 'while' '(' expr ')' statement | 'do' statement 'while' '(' expr ')' end
  | 'for' 'await'? '(' ( ( for_variable | expr )? ';' expr? ';' expr? | ( ( 'var' | 'let' | 'const' ) binding | left ) ( 'of' | 'in' ) expr ) ')' statement
  | ( 'break' | 'continue' ) id? end | 'return' expr? end | 'throw' expr end | 'debugger' end | id ':' statement | 'with' '(' expr ')' statement
  | 'switch' '(' expr ')' '{' ( ( 'case' expr | 'default' ) ':' statement* )* '}' | 'try' block ( 'catch' ( '(' binding @annotation@ ')' )? block ( 'finally' block )? | 'finally' block ) ;
block = '{' statement* '}' ;
variable = ( 'var' | 'let' | 'const' ) declarator ( ',' declarator )* ;
for_variable = variable ;
declarator = binding @annotation@ ( '=' one )? ;
binding = id @definite@ | '[' ( ',' | '...'? binding ( '=' one )? )* ']' | '{' ( property_binding ( ',' property_binding )* ','? )? '}' ;
property_binding = '...' binding | id ( '=' one )? | key ':' binding ( '=' one )? ;
function = @decorators@ 'async'? 'function' '*'? id? @type_params@ '(' params? ')' @returns@ ( block @no_body@ ) ;
params = param ( ',' param )* ','? ;
param = @param_mods@ '...'? ( binding | 'this' ) @optional@ @annotation@ ( '=' one )? ;
class = @decorators@ @abstract@ 'class' id? @type_params@ ( 'extends' left @type_args@ )? @implements@ '{' member* '}' ;
member = ';' | 'static' block | @decorators@ @member_mods@ ( 'static'? ( 'async'? '*'? key | ( 'get' | 'set' ) key ) @optional@ @type_params@ '(' params? ')' @returns@ ( block @no_body@ ) | 'static'? key @optional@ @annotation@ ( '=' one )? end @index_member@ ) ;
key = name | LIT | PRIVATE | '[' one ']' ;
expr = one ( ',' one )* ;
one = arrow | 'yield' ( '*'? one )? | PRIVATE 'in' power | ( @target@ | ( @target@ | @value@ ) ( @access@ | @sent@ )* @access@ ) assign one
  | ( @plain@ ( '**' plain )* ( '**' prefixed )? | prefixed ) ( ( binary power )* | ( ( binary | '||' | '&&' ) power )* | ( ( binary | '??' ) power )* ) ( '?' one ':' one )? @as_more@ ;
power = @plain@ ( '**' plain )* ( '**' prefixed )? | prefixed ;
plain = @plain@ ;
binary = '|' | '^' | '&' | '==' | '!=' | '===' | '!==' | '<' | '>' | '<=' | '>=' | 'instanceof' | 'in' | '<<' | '>a' '>' | '>a' '>a' '>' | '+' | '-' | '*' | '/' | '%' @binary_more@ ;
assign = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>a' '>=' | '>a' '>a' '>=' | '**=' | '&&=' | '||=' | '??=' ;
arrow = 'async'? ( id | @type_params@ '(' params? ')' @returns@ ) '=>' ( one | block ) ;
prefixed = ( '+' | '-' | '!' | '~' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await' ) ( prefixed | plain ) ;
left = ( @target@ | @value@ ) ( @access@ | @sent@ )* ;
new_suffix = '.' ( name | PRIVATE ) | '[' expr ']' | template ;
args = '(' ( '...'? one ( ',' '...'? one )* ','? )? ')' ;
array = '[' ( ',' | '...'? one )* ']' ;
object = '{' ( property ( ',' property )* ','? )? '}' ;
property = '...' one | id ( '=' one )? | key ':' one | ( 'async'? '*'? key | ( 'get' | 'set' ) key ) @type_params@ '(' params? ')' @returns@ block ;
template = HEAD ( MIDDLE expr )* TAIL ;
decorators = ( '@' ( id ( '.' name )* args? | '(' expr ')' ) )* ;
"""
_SCRIPT_ONLY = {"decorators": "decorators"}
_TYPED = {
    "type_only": "'type'?",
    "import_equals": "'import' id '=' ( NAME '(' LIT ')' | id ( '.' name )* ) end",
    "default_more": "| interface",
    "export_more": "| '=' expr end | 'as' NAME id end",
    "declaration_more": "| 'type' id type_params? '=' type end | interface | 'const'? 'enum' id '{' ( key ( '=' one )? ( ',' key ( '=' one )? )* ','? )? '}' | ( 'namespace' | 'module' ) ( id ( '.' name )* | LIT ) '{' item* '}' | 'declare' declaration",
    "more_ids": "| 'abstract' | 'accessor' | 'asserts' | 'declare' | 'infer' | 'interface' | 'is' | 'keyof' | 'module' | 'namespace' | 'override' | 'private' | 'protected' | 'public' | 'readonly' | 'satisfies' | 'type' | 'unique' | 'implements' | 'out'",
    "annotation": "( ':' type )?",
    "definite": "'!'?",
    "optional": "( '?' | '!' )?",
    "decorators": "decorators",
    "type_params": "type_params?",
    "returns": "( ':' ( 'asserts'? ( id | 'this' ) ( 'is' type )? | type ) )?",
    "no_body": "| end",
    "param_mods": "decorators ( 'public' | 'private' | 'protected' | 'readonly' | 'override' )*",
    "abstract": "'abstract'?",
    "implements": "( 'implements' type ( ',' type )* )?",
    "type_args": "type_args?",
    "member_mods": "( 'public' | 'private' | 'protected' | 'readonly' | 'override' | 'abstract' | 'declare' | 'static' | 'accessor' )*",
    "index_member": "| '[' id ':' type ']' ':' type end",
    "as_more": "",
    "binary_more": "",
    "cast": "( '<' ( type | 'const' ) close )?",
    "as_types": "( '!'? ( 'as' ( type | 'const' ) | 'satisfies' type )+ )?",
    "suffix_more": "| '!'",
}
_TYPES = r"""
close = '>' | '>a' ;
type_params = '<' type_param ( ',' type_param )* ','? close ;
type_param = 'const'? ( 'in' | 'out' )* id ( 'extends' type )? ( '=' type )? ;
type_args = '<' type ( ',' type )* ','? close ;
interface = 'interface' id type_params? ( 'extends' type ( ',' type )* )? object_type ;
type = function_type | union ( 'extends' union '?' type ':' type )? ;
function_type = 'abstract'? 'new'? type_params? '(' params? ')' '=>' ( 'asserts'? ( id | 'this' ) ( 'is' type )? | type ) ;
union = ( '|' | '&' )? single ( ( '|' | '&' ) single )* ;
single = ( 'keyof' | 'unique' | 'readonly' | 'infer' )* base ( '[' type? ']' )* ;
base = id ( '.' name )* type_args? | 'void' | 'null' | 'this' | 'true' | 'false' | '-'? LIT | 'typeof' ( id | 'this' ) ( '.' name )* type_args? | 'import' '(' LIT ')' ( '.' name )* type_args? | '(' type ')' | '[' ( tuple_item ( ',' tuple_item )* ','? )? ']' | object_type | HEAD ( MIDDLE type )* TAIL ;
tuple_item = '...'? ( id '?'? ':' )? type '?'? ;
object_type = '{' ( type_member ( ( ';' | ',' | ~ ) type_member )* ( ';' | ',' )? )? '}' ;
type_member = ( '+' | '-' )? 'readonly'? ( key '?'? ( ':' type )? | ( 'get' | 'set' )? key '?'? type_params? '(' params? ')' ( ':' ( 'asserts'? ( id | 'this' ) 'is' type | type ) )? | type_params? '(' params? ')' ( ':' type )? | 'new' type_params? '(' params? ')' ( ':' type )? | '[' id ':' type ']' ':' type | '[' id 'in' type ( 'as' type )? ']' ( ( '+' | '-' )? '?' )? ( ':' type )? ) ;
"""


def _fill(text: str, parts: dict[str, str]) -> str:
    found = 1  # parts name parts; the quoted signs '@' and '@=' are none
    while found:
        text, found = re.subn(r"@(\w+)@", lambda m: parts.get(m[1], ""), text)
    return text


@cache
def grammar(language: str) -> Grammar:
    if language == "java":
        # Words that are keywords in some places only are names in all others.
        names = "( NAME | 'record' | 'sealed' | 'permits' | 'when' | 'non' )"
        return Grammar(re.sub(r"\bNAME\b", names, _fill(JAVA, _JAVA_PARTS)), "unit")
    if language == "python":
        return Grammar(_fill(PYTHON, _PYTHON_PARTS), "file")
    if language == "javascript":
        text = _fill(_SCRIPT, _SCRIPT_PARTS | _SCRIPT_ONLY | {"import_equals": "'import' LIT end"})
        return Grammar(text, "program")
    return Grammar(_fill(_SCRIPT, _SCRIPT_PARTS | _TYPED) + _TYPES, "program")
