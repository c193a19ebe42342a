import pytest

from sourcesieve.dsl.lexer import lexemes
from sourcesieve.dsl.parser import DocumentError, parse
from sourcesieve.plans.program import compile_document

HEAD = 'scope { include "**" }\n'


def kinds(text):
    return [(x.kind, x.span) for x in lexemes(text.encode())]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("", [("EOF", (0, 0))]),
        ("// note\n scope", [("scope", (9, 14)), ("EOF", (14, 14))]),
        ("a_1 12 ..", [("identifier", (0, 3)), ("integer", (4, 6)), ("..", (7, 9)), ("EOF", (9, 9))]),
        ("<= < == = != >= >", [("<=", (0, 2)), ("<", (3, 4)), ("==", (5, 7)), ("=", (8, 9)), ("!=", (10, 12)), (">=", (13, 15)), (">", (16, 17)), ("EOF", (17, 17))]),
        (r'"a\"b" "\q"', [("string", (0, 6)), ("invalid", (7, 9)), ("identifier", (9, 10)), ("invalid", (10, 11)), ("EOF", (11, 11))]),
        ('"open\nx', [("invalid", (0, 5)), ("identifier", (6, 7)), ("EOF", (7, 7))]),
        (r"'a' '\n' ''' 'ab'", [("character", (0, 3)), ("character", (4, 8)), ("character", (9, 12)), ("invalid", (13, 15)), ("identifier", (15, 16)), ("invalid", (16, 17)), ("EOF", (17, 17))]),
        ("! é", [("invalid", (0, 1)), ("invalid", (2, 3)), ("invalid", (3, 4)), ("EOF", (4, 4))]),
    ],
)
def test_lexemes(text, expected):
    assert kinds(text) == expected


@pytest.mark.parametrize(
    "text, message, span",
    [
        ("tokens {}", "Expected 'scope', found 'tokens'.", (0, 6)),
        ("scope { 3 }", "Expected 'include', found 'integer'.", (8, 9)),
        ("scope {", "Expected '}', found 'EOF'.", (7, 7)),
        (HEAD + "tokens { A = }", "Expected 'character', found '}'.", (36, 37)),
        (HEAD + "tokens { A 'x' }", "Expected '=', found 'character'.", (34, 37)),
        (HEAD + "definitions { a = \"x\" }", "Expected 'character', found 'string'.", (41, 44)),
        (HEAD + "tokens { A='a' } syntax { node N { } }", "Expected 'identifier', found '}'.", (58, 59)),
        (HEAD + "tokens { A='a' } rules { rule R { match A report warning at A \"m\" } }", "Expected 'warn', found 'identifier'.", (72, 79)),
        (HEAD + "tokens { A='a' } rules { x }", "Expected 'rule', found 'identifier'.", (48, 49)),
        (HEAD + "rules { } tokens { }", "Expected 'EOF', found 'tokens'.", (33, 39)),
    ],
)
def test_first_error_ends_the_parse(text, message, span):
    with pytest.raises(DocumentError) as e:
        parse(text)
    assert [(p.message, p.span) for p in e.value.problems] == [(message, span)]


TOKENS = "tokens { A = 'a'  B = 'b' }\n"
TREE = TOKENS + "syntax { node R { f: X g*: Y A? } node X { A } node Y { B } }\n"


@pytest.mark.parametrize(
    "body, messages",
    [
        ('scope { exclude "" } tokens { A = \'a\' }', ["Scope pattern must not be empty.", "Scope must contain at least one include."]),
        (HEAD + "definitions { a = 'a' a = 'b' }" + TOKENS, ['Definition "a" is already declared.']),
        (HEAD + "definitions { a = 'z'..'a' }" + TOKENS, ["Character range start must be less than or equal to end."]),
        (HEAD + "definitions { a = b }" + TOKENS, ['Definition "b" is not declared.']),
        (HEAD + "definitions { a = b b = (a|'x') }" + TOKENS, ['Definition "a" is recursive.']),
        (HEAD, ["Tokens must contain at least one token."]),
        (HEAD + "definitions { a = 'a' } tokens { a = 'x' }", ['Token "a" conflicts with a definition of the same name.']),
        (HEAD + "tokens { A = 'a' A = 'b' }", ['Token "A" is already declared.']),
        (HEAD + "definitions { e = 'x'? } tokens { A = e+ B = \"\" C = 'a'* }", ["Token expression must not match empty input."] * 3),
        (HEAD + "tokens { A = fallback B = fallback skip }", ["Tokens may contain at most one fallback token."]),
        (HEAD + TOKENS + "syntax { node N { A } node N { B } }", ['Syntax node "N" is already declared.']),
        (HEAD + TOKENS + "syntax { node A { B } }", ['Syntax node "A" conflicts with token "A".']),
        (HEAD + TOKENS + "syntax { node N { C } }", ['Syntax reference "C" is not declared as a token or syntax node.']),
        (HEAD + TOKENS + "syntax { node N { (A? B*)+ } node M { M A } }", ["Syntax repetition expression must not match empty input.", 'Syntax node "M" is recursive.']),
        (HEAD + TOKENS + 'rules { rule R { match A report info at A "x" } rule R { match C where B.text == "" report info at B "x" } }', ['Rule "R" is already declared.', 'Token "C" is not declared.', 'Where clause must reference matched token "C".', 'Report target must reference matched token "C".']),
        (HEAD + TREE + 'rules { info "m": Z + X where left.text == 3 warn "n": X where left.length > 1 }', ['Syntax node "Z" is not declared.', 'Syntax node property "text" must be compared with a string literal.', 'Where clause references an invalid subject for syntax rule "X".', "Single-match rules cannot reference left or gap subjects."]),
        (HEAD + TREE + 'rules { rule Q { match A inside R report info at A "x" } }', ["Only syntax-node rules may use inside/outside constraints."]),
        (HEAD + TREE + 'rules { info "m": X where X.size == 1 info "k": X where X.blankLines == 1 }', ['Syntax node property "size" is not declared.', 'Property "blankLines" is only valid on subject "gap".']),
        (HEAD + TREE + 'rules { info "m": X where X.length startsWith 1 info "k": X where X.length == X.text info "j": X where X.length == "a" }', ['Property "length" only supports numeric or equality operators.', "Compared properties must use compatible value types.", 'Syntax node property "length" must be compared with an integer literal.']),
        (HEAD + TREE + 'rules { info "m": R where R.h.text == "" info "k": X + Y where gap.f.text == "" rule T { match A where A.f.text == "" report info at A "x" } }', ['Named syntax field "h" is not declared on the selected syntax path.', 'Subject "gap" does not support named syntax-field paths.', "Token rules do not support named syntax-field paths."]),
        (HEAD + TOKENS + 'syntax { node N { A } node M { B } } rules { info "m": N }', ["Syntax rules require exactly one root syntax node."]),
        (HEAD + TREE + 'rules { rule Q { match node X where X.text == "a" report err at Y "x" } }', ['Report target must reference matched syntax node "X".']),
    ],
)
def test_checks(body, messages):
    with pytest.raises(DocumentError) as e:
        compile_document(body)
    assert [p.message for p in e.value.problems] == messages


def test_program():
    p = compile_document(HEAD + TREE + r'rules { rule Q { match A where A.text != "\"\n" report warn at A "é" } info "s": X + Y where right.length >= left.length err "n": X:not(R > *) }')
    assert (p.root, p.node_names, [t.name for t in p.tokens]) == (0, ("R", "X", "Y"), ["A", "B"])
    assert [(r.node, r.target, r.scope, r.scope_kind, r.left, r.severity, r.message) for r in p.rules] == [(False, 0, "", -1, -1, "warn", "é"), (True, 2, "", -1, 1, "info", "s"), (True, 1, "notparent", 0, -1, "err", "n")]
    assert p.rules[0].check.right == b'"\n' and p.rules[1].check.right.subject == "left"
