"""Recursive descent over the tokens of Java 8, with bounded look-ahead by trial."""

from __future__ import annotations

import sys
from collections.abc import Callable

from loomwright.functions.giveup import ParserGaveUp
from loomwright.functions.javasyntax.lexer import MODIFIERS, PRIMITIVES, JavaError, Token, tokens

#: With constructs nested deeper the parser gives up rather than risking the interpreter's stack.
MAX_DEPTH = 1200
#: Frames that this takes; calls between Python functions don't use the machine's stack.
FRAMES = 15_000
#: Trials (casts, lambdas, generics) may look at so many tokens for each token of the text.
TRIAL_BUDGET = 400

_ASSIGN = frozenset("= += -= *= /= &= |= ^= %= <<=".split())
_BINARY = frozenset("|| && | ^ & == != < <= << + - * / %".split())


class _Parser:
    def __init__(self, text: str) -> None:
        self.tokens = tokens(text)
        self.i = 0
        self.depth = 0
        self.steps = 0
        self.limit = TRIAL_BUDGET * (len(self.tokens) + 50)

    # --- tokens ---

    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def peek(self, k: int = 1) -> Token:
        return self.tokens[min(self.i + k, len(self.tokens) - 1)]

    def fail(self, wanted: str) -> JavaError:
        got = self.now
        return JavaError(f"expected {wanted}, got {got.text!r} at line {got.line}" if got.kind != "end" else f"expected {wanted}, got the end of the text at line {got.line}")

    def at(self, *texts: str) -> bool:
        t = self.now
        return t.text in texts and t.kind in ("word", "sign")

    def move(self) -> Token:
        self.steps += 1
        if self.steps > self.limit:
            raise ParserGaveUp(f"too ambiguous at line {self.now.line}")
        t = self.now
        if t.kind != "end":
            self.i += 1
        return t

    def take(self, *texts: str) -> bool:
        if self.at(*texts):
            self.move()
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            raise self.fail(f"'{text}'")

    def name(self) -> str:
        if self.now.kind != "name":
            raise self.fail("a name")
        return self.move().text

    def shift(self) -> str | None:
        """``>>``, ``>>>``, ``>=``, ``>>=``, ``>>>=`` or ``>`` from adjacent signs; nothing is consumed if there is none."""
        if not self.at(">"):
            return None
        k = 1
        while k < 3 and self.peek(k).text == ">" and self.peek(k).at == self.now.at + k:
            k += 1
        t = self.peek(k)
        if t.text in ("=", "==") and t.at == self.now.at + k:
            if t.text == "==":
                return None
            for _ in range(k + 1):
                self.move()
            return ">" * k + "="
        for _ in range(k):
            self.move()
        return ">" * k

    def trial(self, rule: Callable[[], object]) -> bool:
        """Whether the rule holds from here; if not, back to where it began."""
        i, depth = self.i, self.depth
        try:
            rule()
        except JavaError:
            if self.steps > self.limit:
                raise
            self.i, self.depth = i, depth
            return False
        return True

    def nested(self, rule: Callable[[], object]) -> None:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise ParserGaveUp(f"nested too deeply at line {self.now.line}")
        rule()
        self.depth -= 1

    def commas(self, rule: Callable[[], object]) -> None:
        rule()
        while self.take(","):
            rule()

    # --- types ---

    def qualified(self) -> None:
        self.name()
        while self.at(".") and self.peek().kind == "name":
            self.move()
            self.move()

    def annotations(self) -> None:
        while self.at("@") and self.peek().text != "interface":
            self.annotation()

    def annotation(self) -> None:
        self.need("@")
        self.qualified()
        if self.take("(") and not self.take(")"):
            if self.now.kind == "name" and self.peek().text == "=":
                self.commas(self.element_pair)
            else:
                self.element_value()
            self.need(")")

    def element_pair(self) -> None:
        self.name()
        self.need("=")
        self.element_value()

    def element_value(self) -> None:
        if self.at("@"):
            self.annotation()
        elif self.at("{"):
            self.nested(lambda: self.braced(self.element_value))
        else:
            self.ternary()

    def braced(self, item: Callable[[], object]) -> None:
        """``{ item, item, }``"""
        self.need("{")
        while not self.at("}"):
            item()
            if not self.take(","):
                break
        self.need("}")

    def dims(self) -> int:
        n = 0
        while self.trial(self.dim):
            n += 1
        return n

    def dim(self) -> None:
        self.annotations()
        self.need("[")
        self.need("]")

    def type(self) -> None:
        self.annotations()
        if self.now.text in PRIMITIVES and self.now.kind == "word":
            self.move()
        else:
            self.class_type()
        self.dims()

    def class_type(self) -> None:
        while True:
            self.annotations()
            self.name()
            if self.at("<"):
                self.type_arguments()
            if not (self.at(".") and (self.peek().kind == "name" or self.peek().text == "@")):
                return
            self.move()

    def type_arguments(self, diamond: bool = False) -> None:
        self.need("<")
        if diamond and self.take(">"):
            return
        self.nested(lambda: self.commas(self.type_argument))
        self.need(">")

    def type_argument(self) -> None:
        self.annotations()
        if self.take("?"):
            if self.take("extends", "super"):
                self.type()
        else:
            start = self.now
            self.type()
            if start.kind == "word" and self.tokens[self.i - 1] is start:
                raise self.fail("a reference type")

    def type_parameters(self) -> None:
        self.need("<")
        self.commas(self.type_parameter)
        self.need(">")

    def type_parameter(self) -> None:
        self.annotations()
        self.name()
        if self.take("extends"):
            self.class_type()
            while self.take("&"):
                self.class_type()

    # --- declarations ---

    def unit(self) -> None:
        if self.trial(lambda: (self.annotations(), self.need("package"))):
            self.qualified()
            self.need(";")
        while self.at("import", ";"):
            if self.take(";"):
                continue
            self.move()
            self.take("static")
            self.name()
            while self.take("."):
                if self.take("*"):
                    break
                self.name()
            self.need(";")
        while self.now.kind != "end":
            if not self.take(";"):
                self.modifiers()
                self.type_declaration()

    def modifiers(self) -> None:
        while True:
            if self.at("@") and self.peek().text != "interface":
                self.annotation()
            elif self.now.kind == "word" and self.now.text in MODIFIERS and not (self.at("default") and self.peek().text in (":", "->")):
                self.move()
            else:
                return

    def type_declaration(self) -> None:
        if self.take("class"):
            self.name()
            if self.at("<"):
                self.type_parameters()
            if self.take("extends"):
                self.class_type()
            if self.take("implements"):
                self.commas(self.class_type)
            self.class_body()
        elif self.take("enum"):
            self.name()
            if self.take("implements"):
                self.commas(self.class_type)
            self.nested(self.enum_body)
        elif self.take("interface"):
            self.name()
            if self.at("<"):
                self.type_parameters()
            if self.take("extends"):
                self.commas(self.class_type)
            self.class_body()
        elif self.at("@") and self.peek().text == "interface":
            self.move()
            self.move()
            self.name()
            self.class_body()
        else:
            raise self.fail("a class, interface or enum")

    def enum_body(self) -> None:
        self.need("{")
        while self.now.kind == "name" or self.at("@"):
            self.annotations()
            self.name()
            if self.at("("):
                self.arguments()
            if self.at("{"):
                self.class_body()
            if not self.take(","):
                break
        else:
            self.take(",")
        if self.take(";"):
            while not self.at("}"):
                self.member()
        self.need("}")

    def class_body(self) -> None:
        def body() -> None:
            self.need("{")
            while not self.at("}"):
                self.member()
            self.need("}")

        self.nested(body)

    def member(self) -> None:
        if self.take(";"):
            return
        if self.at("{") or (self.at("static") and self.peek().text == "{"):
            self.take("static")
            self.block()
            return
        self.modifiers()
        if self.at("class", "enum", "interface", "@"):
            self.type_declaration()
            return
        if self.at("<"):
            self.type_parameters()
            self.annotations()
        if self.now.kind == "name" and self.peek().text == "(":  # constructor
            self.move()
            self.parameters()
            self.throws()
            self.block()
            return
        if self.take("void"):
            self.name()
            self.method_rest()
            return
        self.type()
        self.name()
        if self.at("("):
            self.method_rest()
            return
        self.declarator_rest()
        while self.take(","):
            self.name()
            self.declarator_rest()
        self.need(";")

    def method_rest(self) -> None:
        self.parameters()
        self.dims()
        self.throws()
        if self.take("default"):  # of an annotation's element
            self.element_value()
        if not self.take(";"):
            self.block()

    def throws(self) -> None:
        if self.take("throws"):
            self.commas(self.class_type)

    def parameters(self) -> None:
        self.need("(")
        if not self.at(")"):
            self.commas(self.parameter)
        self.need(")")

    def parameter(self) -> None:
        self.modifiers()
        self.type()
        self.annotations()
        self.take("...")
        if self.take("this"):
            return
        self.name()
        while self.at("."):  # receiver of an outer class
            self.move()
            if self.take("this"):
                return
            self.name()
        self.dims()

    def declarator_rest(self) -> None:
        self.dims()
        if self.take("="):
            self.initializer()

    def initializer(self) -> None:
        if self.at("{"):
            self.nested(lambda: self.braced(self.initializer))
        else:
            self.expression()

    # --- statements ---

    def block(self) -> None:
        def body() -> None:
            self.need("{")
            while not self.at("}"):
                self.block_statement()
            self.need("}")

        self.nested(body)

    def block_statement(self) -> None:
        if self.at("class", "enum", "interface", "abstract", "strictfp", "static") or (self.at("final", "@") and self.local_class_ahead()):
            self.modifiers()
            self.type_declaration()
        elif self.at("final", "@"):
            self.modifiers()
            self.local_variables()
            self.need(";")
        elif self.declaration_ahead():
            self.local_variables()
            self.need(";")
        else:
            self.statement()

    def local_class_ahead(self) -> bool:
        i = self.i
        found = self.trial(self.modifiers) and self.at("class", "enum", "interface")
        self.i = i
        return found

    def declaration_ahead(self) -> bool:
        """A type and a name: nothing else in the language begins like that."""
        if not (self.now.kind == "name" or (self.now.kind == "word" and self.now.text in PRIMITIVES)):
            return False
        i = self.i
        found = self.trial(lambda: (self.type(), self.name())) and self.at("=", ";", ",", "[", ":")
        self.i = i
        return found

    def local_variables(self) -> None:
        self.type()
        while True:
            self.name()
            self.declarator_rest()
            if not self.take(","):
                return

    def parenthesised(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def statement(self) -> None:
        self.nested(self._statement)

    def _statement(self) -> None:
        t = self.now
        if self.at("{"):
            self.block()
        elif self.take(";"):
            pass
        elif self.take("if"):
            self.parenthesised()
            self.statement()
            if self.take("else"):
                self.statement()
        elif self.take("while"):
            self.parenthesised()
            self.statement()
        elif self.take("do"):
            self.statement()
            self.need("while")
            self.parenthesised()
            self.need(";")
        elif self.take("for"):
            self.for_rest()
        elif self.take("return"):
            if not self.at(";"):
                self.expression()
            self.need(";")
        elif self.take("break", "continue"):
            if self.now.kind == "name":
                self.move()
            self.need(";")
        elif self.take("throw"):
            self.expression()
            self.need(";")
        elif self.take("assert"):
            self.expression()
            if self.take(":"):
                self.expression()
            self.need(";")
        elif self.take("synchronized"):
            self.parenthesised()
            self.block()
        elif self.take("try"):
            self.try_rest()
        elif self.take("switch"):
            self.parenthesised()
            self.switch_body()
        elif t.kind == "name" and self.peek().text == ":":
            self.move()
            self.move()
            self.statement()
        else:
            self.statement_expression()
            self.need(";")

    def statement_expression(self) -> None:
        """Assignments, increments, calls and creations only."""
        start = self.i
        self.expression()
        last = self.tokens[self.i - 1].text
        first = self.tokens[start].text
        assigned = self.assigned_at == start
        if not (assigned or last in (")", "++", "--") or first in ("++", "--") or (first == "new" and last == "}") or last == "}" and "new" in (t.text for t in self.tokens[start : self.i])):
            raise JavaError(f"not a statement at line {self.tokens[start].line}")
        if first == "(" and not assigned and last == ")" and self.tokens[self.i - 2].text != "(" and self._wraps(start):
            raise JavaError(f"not a statement at line {self.tokens[start].line}")

    def _wraps(self, start: int) -> bool:
        """Whether the parenthesis at ``start`` closes at the expression's end."""
        depth = 0
        for k in range(start, self.i):
            depth += (self.tokens[k].text == "(") - (self.tokens[k].text == ")")
            if depth == 0:
                return k == self.i - 1
        return False

    def for_rest(self) -> None:
        self.need("(")
        if not self.take(";"):
            declared = self.at("final", "@") or self.declaration_ahead()
            if declared:
                self.modifiers()
                self.type()
                self.name()
                self.dims()
                if self.take(":"):
                    self.expression()
                    self.need(")")
                    self.statement()
                    return
                if self.take("="):
                    self.initializer()
                while self.take(","):
                    self.name()
                    self.declarator_rest()
            else:
                self.commas(self.statement_expression)
            self.need(";")
        if not self.at(";"):
            self.expression()
        self.need(";")
        if not self.at(")"):
            self.commas(self.statement_expression)
        self.need(")")
        self.statement()

    def try_rest(self) -> None:
        resources = self.take("(")
        if resources:
            while True:
                self.modifiers()
                self.type()
                self.name()
                self.need("=")
                self.expression()
                if not self.take(";") or self.at(")"):
                    break
            self.need(")")
        self.block()
        caught = False
        while self.take("catch"):
            caught = True
            self.need("(")
            self.modifiers()
            self.class_type()
            while self.take("|"):
                self.class_type()
            self.name()
            self.need(")")
            self.block()
        if self.take("finally"):
            self.block()
        elif not (caught or resources):
            raise self.fail("'catch' or 'finally'")

    def switch_body(self) -> None:
        self.need("{")
        while not self.at("}"):
            if self.take("default"):
                self.need(":")
            elif self.take("case"):
                self.ternary()
                self.need(":")
            else:
                raise self.fail("'case' or 'default'")
            while not self.at("}", "case", "default"):
                self.block_statement()
        self.need("}")

    # --- expressions ---

    assigned_at = -1

    def expression(self) -> None:
        self.nested(self._expression)

    def _expression(self) -> None:
        start = self.i
        if self.lambda_ahead():
            self.lambda_rest()
            return
        self.ternary()
        if self.now.kind == "sign" and self.now.text in _ASSIGN:
            self.move()
        else:
            i = self.i
            joined = self.shift()
            if joined not in (">>=", ">>>="):
                self.i = i
                return
        if self.tokens[self.i - 2].kind not in ("name",) and self.tokens[self.i - 2].text not in ("]", ")", ">"):
            raise self.fail("an assignable expression on the left")
        self.expression()
        self.assigned_at = start

    def lambda_ahead(self) -> bool:
        if self.now.kind == "name":
            return self.peek().text == "->"
        if not self.at("("):
            return False
        depth, k = 0, self.i
        while k < len(self.tokens):
            text = self.tokens[k].text
            depth += (text == "(") - (text == ")")
            self.steps += 1
            if depth == 0:
                return self.tokens[min(k + 1, len(self.tokens) - 1)].text == "->"
            if text in (";", "{", "}"):
                return False
            k += 1
        return False

    def lambda_rest(self) -> None:
        if self.now.kind == "name":
            self.move()
        else:
            self.need("(")
            if not self.at(")"):
                if self.now.kind == "name" and self.peek().text in (",", ")"):
                    self.commas(self.name)
                else:
                    self.commas(self.parameter)
            self.need(")")
        self.need("->")
        if self.at("{"):
            self.block()
        else:
            self.expression()

    def ternary(self) -> None:
        self.binary()
        if self.take("?"):
            self.expression_or_lambda()
            self.need(":")
            if self.lambda_ahead():
                self.lambda_rest()
            else:
                self.nested(self.ternary)

    def expression_or_lambda(self) -> None:
        self.expression()

    def binary(self) -> None:
        """Operands and operators in turn; precedence doesn't change what is accepted."""
        self.unary()
        while True:
            if self.take("instanceof"):
                self.type()
                continue
            if self.now.kind == "sign" and self.now.text in _BINARY:
                self.move()
            else:
                i = self.i
                joined = self.shift()
                if joined is None or joined in (">>=", ">>>="):
                    self.i = i
                    return
            self.unary()

    def unary(self) -> None:
        self.nested(self._unary)

    def _unary(self) -> None:
        while self.take("+", "-", "++", "--", "!", "~"):
            pass
        if self.at("(") and self.cast_ahead():
            self.cast()
            if self.lambda_ahead():
                self.lambda_rest()
            else:
                self.unary()
            return
        self.primary()
        while self.take("++", "--"):
            pass

    def cast(self) -> None:
        self.need("(")
        self.type()
        while self.take("&"):
            self.class_type()
        self.need(")")

    def cast_ahead(self) -> bool:
        i = self.i
        primitive = self.peek().text in PRIMITIVES and self.peek().kind == "word"
        found = self.trial(self.cast)
        after = self.now
        wide = self.tokens[self.i - 2].text == "]"
        self.i = i
        if not found:
            return False
        if primitive and not wide:
            return True
        # After a class in parentheses only the beginning of an operand that can't be an operator makes it a cast.
        return after.kind in ("name", "literal") or after.text in ("(", "!", "~", "this", "super", "new", "true", "false", "null", "void") or (after.kind == "word" and after.text in PRIMITIVES)

    def primary(self) -> None:
        t = self.now
        if t.kind == "literal" or self.at("true", "false", "null"):
            self.move()
        elif self.at("("):
            self.parenthesised()
        elif self.take("this"):
            if self.at("("):
                self.arguments()
        elif self.take("super"):
            if self.at("("):
                self.arguments()
            elif self.at("."):
                self.move()
                if self.at("<"):
                    self.type_arguments()
                self.name()
                if self.at("("):
                    self.arguments()
            elif not self.at("::"):
                raise self.fail("'.', '::' or '('")
        elif self.take("new"):
            self.creator()
        elif self.take("void"):
            self.need(".")
            self.need("class")
        elif t.kind == "word" and t.text in PRIMITIVES:
            self.type()
            if self.take("::"):
                if not self.take("new"):
                    self.name()
                return
            self.need(".")
            self.need("class")
        elif t.kind == "name":
            if not self.trial(self.typed_reference):
                self.name()
                if self.at("("):
                    self.arguments()
        else:
            raise self.fail("an expression")
        self.selectors()

    def typed_reference(self) -> None:
        """``List<String>::new``, ``int[]::clone``, ``String[].class``."""
        self.class_type()
        n = self.dims()
        typed = self.tokens[self.i - 1].text in (">", "]")
        if not typed:
            raise self.fail("a type")
        if self.at("::"):
            return
        if not n:
            raise self.fail("'::'")
        self.need(".")
        self.need("class")

    def selectors(self) -> None:
        while True:
            if self.take("."):
                if self.take("new"):
                    self.creator()
                elif self.take("class", "this"):
                    pass
                elif self.take("super"):
                    if self.at("("):
                        self.arguments()
                    elif not self.at("::"):
                        self.need(".")
                        if self.at("<"):
                            self.type_arguments()
                        self.name()
                        if self.at("("):
                            self.arguments()
                else:
                    if self.at("<"):
                        self.type_arguments()
                    if self.take("super"):
                        self.arguments()
                        continue
                    self.name()
                    if self.at("("):
                        self.arguments()
            elif self.at("["):
                self.move()
                self.expression()
                self.need("]")
            elif self.take("::"):
                if self.at("<"):
                    self.type_arguments()
                if not self.take("new"):
                    self.name()
            else:
                return

    def arguments(self) -> None:
        self.need("(")
        if not self.at(")"):
            self.commas(self.expression)
        self.need(")")

    def creator(self) -> None:
        if self.at("<"):
            self.type_arguments()
        self.annotations()
        if self.now.text in PRIMITIVES and self.now.kind == "word":
            self.move()
            if not self.at("[", "@"):
                raise self.fail("'['")
        else:
            while True:
                self.annotations()
                self.name()
                if self.at("<"):
                    self.type_arguments(diamond=True)
                if not self.take("."):
                    break
        if self.at("[", "@"):
            if self.dims():
                self.nested(lambda: self.braced(self.initializer))
                return
            sized = False
            while self.at("[") and self.peek().text != "]":
                self.move()
                self.expression()
                self.need("]")
                sized = True
            if not sized:
                raise self.fail("an array size")
            self.dims()
        else:
            self.arguments()
            if self.at("{"):
                self.class_body()


def check(text: str) -> str | None:
    """Null if the text is a compilation unit of Java 8, else what was wrong. Raises ``ParserGaveUp`` without a verdict."""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, FRAMES))
    try:
        _Parser(text).unit()
    except JavaError as e:
        return f"JavaSyntaxError: {e}"
    except ParserGaveUp:
        raise
    except RecursionError as e:
        raise ParserGaveUp("nested too deeply") from e
    except Exception as e:  # whatever goes wrong is the submission's fault, never the job's
        return f"JavaSyntaxError: unable to parse — {e}"
    finally:
        sys.setrecursionlimit(before)
    return None
