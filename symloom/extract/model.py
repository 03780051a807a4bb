"""What a file yields, and how syntax is named."""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass, field

# The kind of each node type, and the node types that are scopes of a qualified name.
KINDS = {
    "function": ["function_definition", "function_declaration", "function_item", "method_definition", "method_declaration", "generator_function_declaration", "abstract_method_signature"],
    "class": ["class_definition", "class_declaration"],
    "struct": ["struct_item", "struct_specifier"],
    "enum": ["enum_item", "enum_specifier", "enum_declaration"],
    "enum_variant": ["enum_variant", "enumerator", "enum_assignment"],
    "type_alias": ["type_alias_declaration", "type_item", "type_definition"],
    "interface": ["interface_declaration"],
    "impl": ["impl_item"],
    "trait": ["trait_item"],
    "module": ["module", "mod_item"],
    "field": ["field_declaration", "public_field_definition", "field_definition"],
    "macro": ["macro_definition", "preproc_def", "preproc_function_def"],
    "constant": ["const_item", "const_spec", "const_declaration"],
    "static": ["static_item"],
    "union": ["union_specifier"],
    "type": ["type_spec", "type_declaration"],
    "variable": ["var_declaration", "var_spec", "lexical_declaration", "variable_declarator", "assignment"],
    "decorated": ["decorated_definition"],
}
SCOPES = [
    "class_definition", "class_declaration", "struct_item", "struct_specifier", "impl_item", "trait_item", "module", "mod_item",
    "function_definition", "function_declaration", "function_item",
]
#: Scopes whose name is not theirs to give (an impl has a type, a C function a declarator).
NAMELESS = {"impl_item"}

_KIND_OF = {node: kind for kind, nodes in KINDS.items() for node in nodes}


def kind_of(node: str) -> str:
    """The kind of a node type; ``definition`` for any other."""
    return _KIND_OF.get(node, "definition")


@dataclass
class Found:
    """A symbol as read: name, node type, byte span, in order of matching."""

    name: str
    node: str
    start: int
    end: int
    named: bool = True  # gives its name to what lies within it


@dataclass
class Symbol:
    lang: str
    kind: str
    name: str
    fqname: str
    file: str
    start_byte: int
    end_byte: int
    start_line: int
    end_line: int
    signature: str | None
    doc: str | None


@dataclass
class Reference:
    """A call or an import: the index of its symbol in the file, the text it names."""

    owner: int
    to_name: str
    kind: str


@dataclass
class Extraction:
    symbols: list[Symbol] = field(default_factory=list)
    references: list[Reference] = field(default_factory=list)


def qualified_names(file: str, found: list[Found], clean: bool = False) -> list[str]:
    """``file::scopes::name`` of every symbol. A scope that holds the name
    counts, which includes the definition itself if it is one; not with
    ``clean``. One sweep over the spans, with a stack of open scopes."""
    scopes = sorted({(f.start, -f.end, f.name) for f in found if f.node in SCOPES and f.node not in NAMELESS and f.named})
    out = [""] * len(found)
    stack: list[tuple[int, int, str]] = []
    at = 0
    for n in sorted(range(len(found)), key=lambda i: (found[i].start, -found[i].end)):
        me = found[n]
        while at < len(scopes) and scopes[at][:2] <= (me.start, -me.end):
            while stack and -stack[-1][1] <= scopes[at][0]:
                stack.pop()
            stack.append(scopes[at])
            at += 1
        while stack and -stack[-1][1] <= me.start:
            stack.pop()
        own = (me.start, -me.end, me.name)
        names = [s[2] for s in stack if -s[1] >= me.end and not (clean and s == own)]
        if not clean and me.node == "decorated_definition":
            names.append(me.name)  # the definition inside is a scope of its own name
        out[n] = "::".join([file, *names, me.name])
    return out


def owners(found: list[Found], sites: list[int], innermost: bool = False) -> list[int | None]:
    """For each place (in ascending order) the first symbol in order of
    matching that spans it, or the shortest; null if there is none."""
    by_start = sorted(range(len(found)), key=lambda i: found[i].start)
    heap: list[tuple] = []
    out: list[int | None] = []
    at = 0
    for site in sites:
        while at < len(by_start) and found[by_start[at]].start <= site:
            n = by_start[at]
            heapq.heappush(heap, (found[n].end - found[n].start if innermost else 0, n))
            at += 1
        while heap and found[heap[0][1]].end <= site:
            heapq.heappop(heap)
        out.append(heap[0][1] if heap else None)
    return out


def signature(text: str) -> str:
    """A definition up to its body: to a brace, or through a colon before a
    blank or the end, outside round and square brackets; blanks collapsed."""
    depth, end = 0, len(text)
    for i, c in enumerate(text):
        if c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "{" and depth == 0:
            end = i
            break
        elif c == ":" and depth == 0 and i > 0 and text[i + 1 : i + 2] in ("", "\n", " "):
            end = i + 1
            break
    return " ".join(text[:end].split())


_DOC_MARKS = re.compile(r"(?:///|//!|//|/\*\*)+")


def clean_comment(line: str) -> str:
    line = line.strip()
    line = _DOC_MARKS.sub("", line, count=1) if _DOC_MARKS.match(line) else line
    return line.strip().removesuffix("*/").strip().lstrip("*").strip().lstrip("#").strip()


def doc_text(comments: list[str]) -> str | None:
    """The comments before a definition without their marks, or null."""
    lines = [clean_comment(x) for c in comments for x in c.replace("\r\n", "\n").split("\n")]
    return "\n".join(lines).strip() or None
