"""Sources of brace languages as graph rows: C, C++, Objective-C, Rust, Java, Go, JavaScript, TypeScript, Kotlin, Swift.

One tokeniser for all: comments go, strings stay whole, preprocessor lines are read apart. Declarations are told by the
tokens before a brace (their head); what a function holds is read for calls and not for further declarations."""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from dataclasses import dataclass

from loomgraph.functions.python_front import cut_body

LANGUAGES = ("c", "cpp", "objc", "rust", "java", "go", "javascript", "typescript", "kotlin", "swift")
_TOKEN = re.compile(r"""(?P<c>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<s>"(?:\\.|[^"\\\n])*"|`(?:\\.|[^`\\])*`|'(?:\\.|[^'\\\n])*')|(?P<w>[A-Za-z_$@][\w$]*!?)|(?P<n>\d[\w.]*)|(?P<p>->|::|=>|\?\.|[^\s\w])""", re.S)
_LIFETIME = re.compile(r"'(?=[a-z_]\w*\b(?!'))")
#: Words before a bracket that neither call nor name a function.
_NO_CALL = frozenset("if for while switch catch return sizeof alignof typeof new else do try throw yield case struct class enum union interface super @interface @implementation throws".split())
_NO_CALL_OF = {
    "go": "go func defer select range", "rust": "fn match loop where in as", "kotlin": "fun when constructor in is as object", "swift": "func guard where in is as repeat init?",
    "javascript": "function await of in typeof delete", "typescript": "function await of in typeof delete as", "java": "synchronized", "c": "defined", "cpp": "defined decltype noexcept", "objc": "defined",
}
_TYPES = {
    "class": "Class", "struct": "Struct", "union": "Struct", "record": "Class", "object": "Class", "actor": "Class", "enum": "Enum", "interface": "Interface", "trait": "Interface", "protocol": "Interface",
    "@interface": "Class", "@implementation": "Class", "@protocol": "Interface", "extension": "Class", "impl": "impl", "namespace": "scope", "mod": "scope", "module": "scope",
}
_TYPES_OF = {
    "c": "struct union enum", "cpp": "class struct union enum namespace", "objc": "struct union enum @interface @implementation @protocol", "rust": "struct union enum trait impl mod", "java": "class interface enum record @interface",
    "go": "struct interface", "javascript": "class", "typescript": "class interface enum namespace module", "kotlin": "class interface object enum", "swift": "class struct enum protocol extension actor",
}
_OWN = ("self", "this", "super", "Self")


@dataclass(frozen=True)
class Token:
    text: str
    at: int
    end: int
    kind: str


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m[0])


def import_target(text: str) -> str:
    """What an import statement names; as functions.text.import_target."""
    s = text.strip()
    quoted = re.search(r"['\"]([^'\"]+)['\"]", s)
    if s.startswith(("#include", "#import")):
        m = re.search(r"[<\"]([^>\"]+)[>\"]", s)
        return m[1] if m else s
    if re.match(r"(pub\s+)?use\s", s):
        return re.sub(r"^(pub\s+)?use\s+", "", s).rstrip(";").strip()
    if quoted:
        return quoted[1]
    m = re.match(r"import\s+(?:static\s+)?([\w.]+)", s)
    return m[1].rstrip(".") if m else s


def imported_names(text: str) -> str:
    """The names that an import statement brings in, comma-joined; empty for whole modules and wildcards."""
    s = text.strip()
    if s.startswith("#"):
        return ""
    braces = re.search(r"\{(.*?)\}", s, re.S)
    if "from" in s and s.startswith("import"):
        if braces:
            return ",".join(p.split(" as ")[-1].strip() for p in braces[1].split(",") if p.strip())
        head = s[6:].split("from")[0].strip().rstrip(",").strip()
        return "" if "* as" in s else head
    if s.startswith("use ") or s.startswith("pub use "):
        if braces:
            return ",".join(p.strip() for p in braces[1].split(",") if p.strip())
        return import_target(s).rsplit("::", 1)[-1]
    if re.search(r"['\"]", s):
        alias = re.match(r"(?:import\s+)?([\w.]+)\s+['\"]", s)
        return alias[1] if alias and alias[1] != "import" else import_target(s).rsplit("/", 1)[-1]
    return import_target(s).rsplit(".", 1)[-1] if s.startswith("import") else ""


def call_name(text: str) -> tuple[str, str]:
    """(callee, qualifier) of a called expression, cut at the last of the first separator it holds: ->, :: or a dot."""
    for sep in ("->", "::", "."):
        if sep in text:
            q, _, name = text.rpartition(sep)
            return name, "" if q in _OWN else q
    return text, ""


class Reader:
    def __init__(self, path: str, language: str, text: str):
        self.path, self.lang, self.source = path, language, text
        self.rows: list[tuple[str, str, str, str, str]] = []
        self.breaks = [m.end() for m in re.finditer("\n", text)]
        self.keywords = _NO_CALL | frozenset(_NO_CALL_OF[language].split())
        self.kinds = frozenset(_TYPES_OF[language].split())
        self.file = f"file:{path}"
        plain = text
        if language in ("c", "cpp", "objc"):
            plain = self._preprocessor(plain)
        if language == "rust":
            plain = _LIFETIME.sub(" ", plain)
        found = [m for m in _TOKEN.finditer(plain) if m.lastgroup != "c"]
        self.toks = [Token(m[0], m.start(), m.end(), m.lastgroup) for m in found]
        self.match = self._brackets()
        self._imports(re.sub(r"//[^\n]*|/\*.*?\*/", _blank, plain, flags=re.S))

    # --- output
    def line(self, at: int) -> int:
        """The line of a place, from 0."""
        return bisect_right(self.breaks, at)

    def add(self, kind: str, i: str, other: str, name: str, **props) -> None:
        self.rows.append((kind, i, other, name, json.dumps(props)))

    def node(self, i: str, label: str, name: str, a: int, b: int, owner: str, **props) -> None:
        body, cut = cut_body(self.source[a:b])
        self.add("node", i, label, name, file=self.path, line_start=self.line(a) + 1, line_end=self.line(max(a, b - 1)) + 1, body=body, body_truncated=cut, **props)
        self.add("edge", owner, i, "CONTAINS")

    # --- what needs no tokens
    def _preprocessor(self, text: str) -> str:
        def take(m: re.Match) -> str:
            d = re.match(r"\s*#\s*(include|import|define)\b\s*(.*)", m[0], re.S)
            if d and d[1] == "define":
                name = re.match(r"\w+", d[2])
                if name:
                    self.node(f"macro:{self.path}:{name[0]}", "Macro", name[0], m.start(), m.end(), self.file)
            elif d:
                self._import("#include " + d[2].strip())
            return _blank(m)

        return re.sub(r"(?m)^[ \t]*#(?:\\\n|[^\n])*", take, text)

    def _import(self, statement: str) -> None:
        t = import_target(statement)
        if t:
            self.add("node", f"module:{t}", "Module", t, path=t)
            self.add("edge", self.file, f"module:{t}", "IMPORTS", names=imported_names(statement))

    def _imports(self, text: str) -> None:
        if self.lang == "go":
            for m in re.finditer(r"(?m)^\s*import\s*(\((.*?)\)|[^\n]*)", text, re.S):
                for part in (m[2] if m[2] is not None else m[1]).split("\n"):
                    if '"' in part:
                        self._import(part.strip() if m[2] is not None else "import " + part.strip())
        elif self.lang == "rust":
            for m in re.finditer(r"(?m)^\s*((?:pub\s+)?use\s+[^;]+;)", text):
                self._import(m[1])
        elif self.lang in ("javascript", "typescript"):
            for m in re.finditer(r"(?m)^\s*(import\s+(?:[^;'\"]*?from\s*)?['\"][^'\"\n]+['\"])", text):
                self._import(m[1])
        elif self.lang in ("java", "kotlin", "swift"):
            for m in re.finditer(r"(?m)^\s*(import\s+[\w.* ]+)", text):
                self._import(m[1].strip())

    # --- tokens
    def _brackets(self) -> dict[int, int]:
        out, stack = {}, []
        close = {")": "(", "]": "[", "}": "{"}
        for i, t in enumerate(self.toks):
            if t.kind != "p":
                continue
            if t.text in "([{":
                stack.append(i)
            elif t.text in close:
                while stack and self.toks[stack[-1]].text != close[t.text]:
                    out[stack.pop()] = i
                if stack:
                    out[stack.pop()] = i
        for i in stack:
            out[i] = len(self.toks) - 1
        return out

    def walk(self, i: int, end: int, owner: str, kind: str = "") -> None:
        """Declarations among the tokens i to end; owner holds them, kind is its label."""
        head: list[int] = []
        lines = self.lang in ("go", "kotlin", "swift", "javascript", "typescript")
        while i < end:
            t = self.toks[i]
            if lines and head and self.line(self.toks[head[-1]].end - 1) < self.line(t.at) and self._ended(head, t):
                self.statement(head, owner, kind)
                head = []
            if t.text in (";", "}") or t.text == "," and kind == "Enum":
                self.statement(head, owner, kind)
                head = []
            elif t.text == "{":
                stop = self.match.get(i, end)
                self.braced(head, i, stop, owner, kind)
                i = stop
                if self.lang in ("c", "cpp", "objc") and any(self.toks[k].text == "typedef" for k in head):
                    after = i + 1
                    if after < end and self.toks[after].kind == "w":
                        name = self.toks[after].text
                        self.node(f"typealias:{self.path}:{name}", "TypeAlias", name, self.toks[head[0]].at, self.toks[after].end, owner)
                head = []
            elif t.text in ("(", "["):
                stop = self.match.get(i, end)
                head += range(i, min(stop + 1, end))
                i = stop
            else:
                head.append(i)
            i += 1
        self.statement(head, owner, kind)

    def _ended(self, head: list[int], t: Token) -> bool:
        """Whether a line break after the head ends it."""
        last = self.toks[head[-1]].text
        return last not in (",", "(", "=", "=>", ".", ":", "->", "|", "&", "+", "<") and t.text not in (".", "{", ":", "=>", "->", "|", "&", ",", "?.", "=")

    def _flat(self, head: list[int]) -> list[int]:
        """The head without what stands in brackets and between < and >."""
        out, depth, angle = [], 0, 0
        for k in head:
            x = self.toks[k].text
            if x in ("(", "["):
                depth += 1
            elif x in (")", "]"):
                depth -= 1
            elif not depth:
                if x == "<":
                    angle += 1
                elif x == ">" and angle:
                    angle -= 1
                elif not angle:
                    out.append(k)
        return out

    def braced(self, head: list[int], i: int, stop: int, owner: str, kind: str) -> bool:
        """A head with a body from i to stop: a type, a scope, or a function. False if it is none of them."""
        flat = self._flat(head)
        words = [self.toks[k].text for k in flat]
        if self.lang == "go" and "type" in words[:1] and len(words) > 2:
            return self.type_of(head, flat, words, "struct" if "struct" in words else "interface", words[1], i, stop, owner)
        if self.lang == "go" and words[:1] == ["type"]:
            return False
        for p, w in enumerate(words):
            if w in self.kinds and not (w == "class" and self.lang == "kotlin" and "enum" in words[:p]) and not self._function(head, before=flat[p]):
                if w == "enum" and "class" in words[p + 1 : p + 2]:
                    p += 1
                name = next((x for k, x in zip(flat[p + 1 :], words[p + 1 :]) if self.toks[k].kind == "w" and x not in ("class", "struct")), "")
                return self.type_of(head, flat, words, w, name, i, stop, owner)
        f = self._function(head)
        if f is None:
            if words[:1] == ["extern"]:
                self.walk(i + 1, stop, owner, kind)
                return True
            return False
        self.function(head, f, i, stop, owner, kind)
        return True

    def type_of(self, head: list[int], flat: list[int], words: list[str], w: str, name: str, i: int, stop: int, owner: str) -> bool:
        label = _TYPES[w]
        a, b = self.toks[head[0]].at, self.toks[min(stop, len(self.toks) - 1)].end
        if label == "scope":
            self.walk(i + 1, stop, owner)
            return True
        if label == "impl":
            at = words.index("for") if "for" in words else None
            names = [x for k, x in zip(flat, words) if self.toks[k].kind == "w" and x not in ("impl", "for", "where", "const", "unsafe", "dyn")]
            if not names:
                return True
            if at is not None:
                after = [x for k, x in list(zip(flat, words))[at + 1 :] if self.toks[k].kind == "w" and x != "dyn"]
                before = [x for k, x in list(zip(flat, words))[:at] if self.toks[k].kind == "w" and x not in ("impl", "unsafe", "const")]
                target = after[0] if after else names[-1]
                if before:
                    self.add("edge", f"struct:{self.path}:{target}", f"interface:{self.path}:{before[-1]}", "IMPLEMENTS")
            else:
                target = names[0]
            self.walk(i + 1, stop, f"struct:{self.path}:{target}", "impl")
            return True
        if not name:
            return True
        me = f"{label.lower()}:{self.path}:{name}"
        shell = {"is_abstract": "abstract" in words} if label == "Class" else {}
        self.node(me, label, name, a, b, owner, is_exported=self.exported(head, name), **shell)
        self._bases(me, words)
        at = len(self.rows)
        self.walk(i + 1, stop, me, label)
        if label == "Class":  # the shell: bodies of methods are left out of the class's own
            holes = [(json.loads(r[4]).get("hole")) for r in self.rows[at:] if r[0] == "node" and r[2] == "Function"]
            text, last = [], a
            for x, y in sorted(h for h in holes if h):
                text.append(self.source[last:x] + "{ ... }")
                last = y
            body, cut = cut_body("".join(text) + self.source[last:b])
            k = next(k for k in range(at - 1, -1, -1) if self.rows[k][1] == me and self.rows[k][0] == "node")
            props = json.loads(self.rows[k][4]) | {"body": body, "body_truncated": cut}
            self.rows[k] = (*self.rows[k][:4], json.dumps(props))
        return True

    def _bases(self, me: str, words: list[str]) -> None:
        mode = ""
        stop = {"public", "private", "protected", "virtual", "open", "where", "final", "{", ","}
        for w in words:
            if w in ("extends", "implements"):
                mode = w
            elif w == ":" and self.lang in ("cpp", "objc", "kotlin", "swift") and not mode:
                mode = "extends"
            elif w == "where":
                break
            elif mode and re.match(r"[A-Za-z_]", w) and w not in stop:
                if mode == "implements":
                    self.add("edge", me, f"interface:{self.path}:{w}", "IMPLEMENTS")
                else:
                    self.add("edge", me, f"class:{self.path}:{w}", "INHERITS")

    def _function(self, head: list[int], before: int | None = None) -> tuple[str, int] | None:
        """(name, index of the opening bracket of the parameters) if the head is a function's; `before` bounds the name."""
        toks, lang = self.toks, self.lang
        words = [toks[k].text for k in head]
        if lang == "objc" and words[:1] and words[0] in ("-", "+"):
            name = next((toks[k].text for k in head[1:] if toks[k].kind == "w" and not self._inside(head, k)), None)
            return (name, -1) if name and before is None else None
        mark = {"rust": "fn", "go": "func", "kotlin": "fun", "swift": "func"}.get(lang)
        if mark:
            if lang == "swift" and "init" in words and mark not in words:
                at = words.index("init")
                return ("init", head[at + 1]) if at + 1 < len(words) and words[at + 1] == "(" and (before is None or head[at] < before) else None
            if mark not in words or before is not None and head[words.index(mark)] > before:
                return None
            p = words.index(mark) + 1
            if lang == "go" and p < len(words) and words[p] == "(":  # the receiver
                p = head.index(self.match.get(head[p], head[p])) + 1 if self.match.get(head[p]) in head else p
            while p < len(words) and toks[head[p]].kind != "w":
                p = head.index(self.match[head[p]]) + 1 if words[p] in ("(", "[") and self.match.get(head[p]) in head else p + 1
            if lang == "kotlin":
                while p + 2 < len(words) and words[p + 1] == ".":
                    p += 2
            if p >= len(words):
                return None
            q = next((k for k in head[p + 1 :] if toks[k].text == "("), None)
            return (toks[head[p]].text, q) if q is not None else None
        if lang in ("javascript", "typescript"):
            m = next((p for p, w in enumerate(words) if w == "function"), None)
            if m is not None:
                q = next((k for k in head[m:] if toks[k].text == "("), None)
                named = m + 1 < len(words) and toks[head[m + 1]].kind == "w"
                name = words[m + 1] if named else self._assigned(words)
                return (name, q) if name and q is not None and (before is None or head[m] < before) else None
            if "=>" in words:
                name = self._assigned(words)
                q = next((k for k in head[: words.index("=>")] if toks[k].text == "("), -1)
                return (name, q) if name and before is None else None
        if "=" in words and "operator" not in words:
            return None
        for p in range(len(head) - 1):
            if toks[head[p]].kind == "w" and words[p + 1] == "(" and words[p] not in self.keywords and not self._inside(head, head[p]):
                if words[p].startswith("@") or lang == "java" and p and words[p - 1] == "new":
                    continue
                return (words[p], head[p + 1]) if before is None or head[p] < before else None
        return None

    @staticmethod
    def _assigned(words: list[str]) -> str:
        for sep in ("=", ":"):
            if sep in words:
                at = words.index(sep)
                left = [w for w in words[:at] if re.match(r"[A-Za-z_$]", w) and w not in ("const", "let", "var", "export", "default", "public", "private", "static", "readonly", "async")]
                if left:
                    return left[0] if sep == "=" and ":" in words[:at] else left[-1]
        return ""

    def _inside(self, head: list[int], k: int) -> bool:
        """Whether token k lies in brackets of the head."""
        return any(a < k < self.match.get(a, -1) for a in head if self.toks[a].text in ("(", "["))

    def exported(self, head: list[int], name: str) -> bool:
        words = {self.toks[k].text for k in head}
        return {
            "rust": "pub" in words, "java": "public" in words, "go": name[:1].isupper(), "javascript": "export" in words, "typescript": "export" in words,
            "kotlin": not words & {"private", "internal"}, "swift": bool(words & {"public", "open"}),
        }.get(self.lang, "static" not in words)

    def function(self, head: list[int], found: tuple[str, int], i: int, stop: int, owner: str, kind: str) -> None:
        name, q = found
        a, b = self.toks[head[0]].at, self.toks[min(stop, len(self.toks) - 1)].end
        me = f"func:{self.path}:{name}:{self.line(a)}"
        params = self.source[self.toks[q].at : self.toks[self.match[q]].end] if q >= 0 and q in self.match else ""
        text = self.source[a:b]
        if self.lang == "go" and kind == "" and q >= 0:
            receiver = re.match(r"func\s*\(\s*\w*\s*\*?\s*(\w+)[^)]*\)", text)
            owner = f"struct:{self.path}:{receiver[1]}" if receiver else owner
        self.node(me, "Function", name, a, b, owner, params=params, is_exported=self.exported(head, name), return_type=self._returns(head, name, q), hole=[self.toks[i].at, b], flags=[k for k, v in flags(self.lang, text).items() if v])
        for k, p in enumerate(self._params(q)):
            self.add("node", f"param:{me}:{k}", "Parameter", p, index=k, function=name)
            self.add("edge", me, f"param:{me}:{k}", "CONTAINS")
        self.calls(me, i + 1, stop)

    def _returns(self, head: list[int], name: str, q: int) -> str:
        words = [self.toks[k].text for k in head]
        if q < 0 or q not in self.match:
            return ""
        after = [self.toks[k].text for k in head if k > self.match[q]]
        if self.lang in ("c", "cpp", "objc", "java"):
            skip = {"static", "inline", "extern", "public", "private", "protected", "final", "virtual", "abstract", "synchronized", "native", "const"}
            return " ".join(w for w in words[: words.index(name)] if w not in skip and not w.startswith("@"))
        if "=>" in after:
            after = after[: after.index("=>")]
        return "".join(after).lstrip("->:").split("where")[0].removesuffix("throws") if after else ""

    def _params(self, q: int) -> list[str]:
        if q < 0 or q not in self.match:
            return []
        out, part, k = [], [], q + 1
        while k < self.match[q]:
            t = self.toks[k]
            if t.text == ",":
                out.append(part)
                part = []
            else:
                part.append(t.text)
                if t.text in ("(", "[", "{", "<") and k in self.match:
                    k = self.match[k]
            k += 1
        names = []
        for p in [*out, part]:
            p = p[: p.index("=")] if "=" in p else p
            words = [w for w in p if re.match(r"[A-Za-z_$]", w)]
            if not words or words == ["void"]:
                continue
            if ":" in p:
                before = [w for w in p[: p.index(":")] if re.match(r"[A-Za-z_$]", w) and w not in ("mut", "ref", "val", "var", "inout", "public", "private", "readonly", "protected")]
                names += before[-1:]
            elif self.lang in ("c", "cpp", "objc", "java"):
                names.append(words[-1])
            else:
                names += [w for w in words if w not in ("mut", "self")][:1]
        return [n for n in names if n not in ("self", "this")]

    def calls(self, me: str, i: int, stop: int) -> None:
        for k in range(i, min(stop, len(self.toks))):
            t = self.toks[k]
            if t.kind != "w" or k + 1 >= len(self.toks) or self.toks[k + 1].text != "(" or t.text in self.keywords or t.text.endswith("!"):
                continue
            parts, j = [t.text], k - 1
            while j - 1 >= i and self.toks[j].text in (".", "->", "::", "?."):
                sep = "." if self.toks[j].text == "?." else self.toks[j].text
                before = self.toks[j - 1]
                if before.kind == "w":
                    parts = [before.text, sep, *parts]
                    j -= 2
                else:
                    break
            if self.toks[j].text in ("new", "function", "func", "fn", "fun", "def"):
                continue
            callee, q = call_name("".join(parts))
            self.add("edge", me, f"funcref:{q}.{callee}" if q else f"funcref:{callee}", "CALLS", qualifier=q, callee=callee)
        if self.lang == "objc":  # messages
            for m in re.finditer(r"\[\s*(\w+)\s+(\w+)", self.source[self.toks[i].at : self.toks[min(stop, len(self.toks) - 1)].at] if i < len(self.toks) else ""):
                q = "" if m[1] in _OWN else m[1]
                self.add("edge", me, f"funcref:{q}.{m[2]}" if q else f"funcref:{m[2]}", "CALLS", qualifier=q, callee=m[2])

    def statement(self, head: list[int], owner: str, kind: str) -> None:
        """A head without a body: an alias, a field, a type or function without one."""
        if not head:
            return
        flat = self._flat(head)
        words = [self.toks[k].text for k in flat]
        a, b = self.toks[head[0]].at, self.toks[head[-1]].end
        is_word = lambda k: self.toks[k].kind == "w"
        if words[:1] == ["typedef"]:
            names = [self.toks[k].text for k in flat if is_word(k)]
            pointer = re.search(r"\(\s*\*\s*(\w+)\s*\)", self.source[a:b])
            self.node(f"typealias:{self.path}:{pointer[1] if pointer else names[-1]}", "TypeAlias", pointer[1] if pointer else names[-1], a, b, owner)
        elif "=" in words and ("type" in words[:3] and self.lang in ("rust", "typescript") or words[:1] == ["typealias"] or "using" in words[:1]) or self.lang == "go" and words[:1] == ["type"] and len(words) > 2:
            mark = next(w for w in ("type", "typealias", "using") if w in words)
            name = words[words.index(mark) + 1]
            self.node(f"typealias:{self.path}:{name}", "TypeAlias", name, a, b, owner)
        elif any(w in self.kinds for w in words[:3]) and not kind and self.lang in ("rust", "kotlin", "java", "swift"):
            w = next(x for x in words if x in self.kinds)
            after = words[words.index(w) + 1 :]
            if after and _TYPES[w] in ("Struct", "Class", "Enum", "Interface") and re.match(r"\w", after[0]):
                i = f"{_TYPES[w].lower()}:{self.path}:{after[0]}"
                self.node(i, _TYPES[w], after[0], a, b, owner, is_exported=self.exported(head, after[0]))
                self._bases(i, words)
        elif self.lang in ("kotlin", "javascript", "typescript") and (f := self._function(head)) is not None and ("fun" in words or "=>" in words or "function" in words):
            name, q = f
            me = f"func:{self.path}:{name}:{self.line(a)}"
            params = self.source[self.toks[q].at : self.toks[self.match[q]].end] if q in self.match else ""
            self.node(me, "Function", name, a, b, owner, params=params, is_exported=self.exported(head, name), flags=[k for k, v in flags(self.lang, self.source[a:b]).items() if v])
            arrow = next((k for k in head if self.toks[k].text == "=>"), None)
            self.calls(me, (arrow if arrow is not None else self.match.get(q, head[0])) + 1, head[-1] + 1)
        elif kind in ("Class", "Struct", "Interface") and not any(w in ("(", "return") for w in [self.toks[k].text for k in head if self.toks[k].text == "("]):
            names = self._field(words, flat)
            for n, k in names:
                self.add("node", f"field:{owner}:{self.line(self.toks[k].at)}:{self.toks[k].at - (self.breaks[self.line(self.toks[k].at) - 1] if self.line(self.toks[k].at) else 0)}", "Field", n, file=self.path)
                self.add("edge", owner, f"field:{owner}:{self.line(self.toks[k].at)}:{self.toks[k].at - (self.breaks[self.line(self.toks[k].at) - 1] if self.line(self.toks[k].at) else 0)}", "CONTAINS")

    def _field(self, words: list[str], flat: list[int]) -> list[tuple[str, int]]:
        if self.lang in ("c", "cpp", "objc", "java"):
            cut = words.index("=") if "=" in words else len(words)
            own = [(w, k) for w, k in zip(words[:cut], flat) if self.toks[k].kind == "w"]
            return own[-1:] if len(own) > 1 else []
        if self.lang == "go":
            return [(words[0], flat[0])] if len(words) > 1 and self.toks[flat[0]].kind == "w" else []
        out = []
        for p, w in enumerate(words):  # every name before a colon, or a declared one
            if w == ":" and p and self.toks[flat[p - 1]].kind == "w":
                out.append((words[p - 1], flat[p - 1]))
        if not out and self.lang in ("kotlin", "swift", "javascript", "typescript"):
            own = [(w, k) for w, k in zip(words, flat) if self.toks[k].kind == "w" and w not in ("val", "var", "let", "static", "private", "public", "readonly", "override")]
            return own[:1] if "=" in words else []
        return out if self.lang == "rust" else out[:1]


def flags(language: str, text: str) -> dict[str, bool]:
    """Pattern flags of a function's text, by language."""
    head = text.split("{", 1)[0]
    has = lambda *parts: any(p in text for p in parts)
    found = lambda pattern: re.search(pattern, text) is not None
    if language == "rust":
        return {"has_unsafe_block": found(r"\bunsafe\s*\{"), "is_unsafe_fn": "unsafe " in head, "has_transmute": has("transmute"), "has_unwrap": has(".unwrap()"), "has_raw_deref": found(r"(?:[=(,;{]|return|&|!)\s*\*\s*[a-z_]\w*")}
    if language == "java":
        return {"has_reflection": has("Class.forName", "getMethod(", "getDeclaredMethod(", ".invoke(", "newInstance("), "has_serialization": has("Serializable", "ObjectInputStream", "readObject"), "has_synchronized": has("synchronized"), "has_native": bool(re.search(r"\bnative\b", head))}
    if language == "go":
        return {"has_goroutine": found(r"\bgo\s+[\w.]+\s*[({]|\bgo\s+func\b"), "has_defer": found(r"\bdefer\s"), "has_channel_op": has("<-"), "has_unsafe_pointer": has("unsafe.Pointer"), "has_error_check": has("err != nil", "err == nil")}
    if language in ("javascript", "typescript"):
        out = {"has_dangerous_eval": has("eval("), "has_innerHTML": has("innerHTML", "outerHTML", "document.write"), "has_dynamic_import": has("import("), "has_prototype_pollution": has("__proto__", "constructor.prototype", "Object.setPrototypeOf")}
        return out if language == "javascript" else out | {"has_type_assertion": has(" as "), "has_any_type": has(": any", "as any")}
    if language == "python":
        deserial = has("pickle.load", "pickle.loads", "marshal.load", "shelve.open") or has("yaml.load(") and not has("SafeLoader", "safe_load")
        sql = bool(re.search(r"(?i)\b(SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER)\b", text)) and (found(r"\bf[\"']") or has(".format(", "%"))
        return {"has_dangerous_exec": has("exec("), "has_dangerous_eval": has("eval("), "has_unsafe_deserialization": deserial, "has_subprocess_shell": has("shell=True") and has("subprocess", "Popen"), "has_sql_string_format": sql}
    if language == "kotlin":
        return {"has_coroutine": "suspend" in head.split() or has("launch", "async", "runBlocking", "withContext"), "has_force_unwrap": has("!!"), "has_safe_call": has("?.")}
    if language == "swift":
        return {"has_force_unwrap": found(r"[a-zA-Z_\])]\w*!(?!=)"), "has_optional_chain": has("?."), "has_force_try": has("try!"), "has_weak_ref": has("weak ", "unowned ")}
    return {}


def rows_of(path: str, language: str, text: str) -> list[tuple[str, str, str, str, str]]:
    """(kind, id, other, name, props as JSON): node and edge rows of a file; what cannot be read gives no rows."""
    r = Reader(path, language, text)
    r.walk(0, len(r.toks), r.file)
    return r.rows
