"""Chunks along syntax, signatures, imports of several languages, kinds of edges."""

from quarry.operators import chunks, modules

SOURCE = '''# a comment that belongs to the first statement
import os


@decorate(
    1)
class Shelf(Base):
    """Holds things."""

    # about put
    @property
    def put(self, x: int = 1,
            *rest) -> None:
        "Puts."
        if x:
            return None
        else:
            self.x = x; self.y = [
                1]

    async def naïve(self): return "ä"
'''


def test_signatures_and_docstrings():
    found = {s["qualname"]: (s["signature"], s["doc"]) for s in chunks.parse_python(SOURCE.replace("\n", "\r\n"))["symbols"]}
    assert found == {"Shelf": ("class Shelf(Base)", "Holds things."), "Shelf.put": ("def put(self, x: int = 1, *rest) -> None", "Puts."), "Shelf.naïve": ("async def naïve(self)", "")}


def test_every_line_is_in_one_syntax_chunk():
    blocks = [SOURCE, "x = 1\n\n", "def f():\n" + "    y = 2\n" * 400, "try:\n" + "    a()\n" * 200 + "except E:\n    b()\nelse:\n" + "    c()\n" * 200, 'z = """\n' + "literal\n" * 900 + '"""\n', "# the end\n"]
    text = "".join(blocks)
    for limit in (60, 200, 1500):
        found = chunks.syntax_chunks(text, chunks.parse_python(text)["tree"], limit)
        lines = text.split("\n")
        held = [n for a, b, _ in found for n in range(a, b + 1)]
        assert held == sorted(set(held)) and all(not lines[n - 1].strip() for n in set(range(1, len(lines) + 1)) - set(held))
        assert all(t == "\n".join(lines[a - 1 : b]) and len(t) <= 2 * limit for a, b, t in found)


def test_file_chunks_of_odd_files(spark):
    rows = [("a.py", "def f(:"), ("b.py", None), ("c.py", "   \n\n"), ("d.md", "# title\ntext"), ("e.py", "class A:\n    def m(self):\n        pass\n"), (None, "x = 1")]
    got = {r["path"]: (r["first_line"], r["last_line"], r["symbol"], r["header"]) for r in chunks.file_chunks(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert got == {"a.py": (1, 1, -1, "a.py"), "d.md": (1, 2, -1, "d.md"), "e.py": (1, 3, 0, "e.py :: defines class A\nclass A")}


def test_module_names(spark):
    rows = [
        ("a.ts", "typescript", "import x, {y} from './b';\nimport \"./c\"\nconst d = require('d')\nimport z from './b'"), ("a.go", "go", 'import (\n  f "fmt"\n  "host/x/y"\n)\nvar s = "no"\n'),
        ("A.java", "java", "import static a.b.C;\nimport a.d.*;\n"), ("a.c", "c", '#include <stdio.h>\n # include "x/y.h"\n'), ("a.rs", "rust", "use crate::a::b;\npub use std::{io, fmt};\n"), ("a.md", "markdown", "import 'x'"), ("b.rs", "rust", None),
    ]
    got = {}
    for r in modules.module_names(spark.createDataFrame(rows, "path string, lang string, content string")).collect():
        got.setdefault(r["path"], []).append(r["module"])
    assert got == {"a.ts": ["./b", "./c", "d"], "a.go": ["fmt", "host/x/y"], "A.java": ["a.b.C", "a.d"], "a.c": ["stdio.h", "x/y.h"], "a.rs": ["crate::a::b", "std"]}


def test_module_targets(spark):
    files = [
        ("src/pkg/__init__.py", "python"), ("src/pkg/util.py", "python"), ("lib/pkg/util.py", "python"), ("web/a.ts", "typescript"), ("web/b/index.ts", "typescript"), ("web/a.js", "javascript"),
        ("cmd/run/main.go", "go"), ("cmd/run/more.go", "go"), ("cmd/run/note.txt", "text"), ("z/run/x.go", "go"), ("j/com/x/Y.java", "java"), ("inc/net/sock.h", "c"), ("src/net.c", "c"), ("src/sock.h", "c"), ("src/store/mod.rs", "rust"), ("src/g1/m0.rs", "rust"),
    ]
    asked = {
        ("src/pkg/x.py", "python", "pkg.util"): ["lib/pkg/util.py"], ("src/pkg/x.py", "python", ".util"): ["src/pkg/util.py"], ("src/pkg/x.py", "python", "."): ["src/pkg/__init__.py"], ("src/pkg/x.py", "python", "os"): [],
        ("web/c.ts", "typescript", "./a"): ["web/a.ts"], ("web/c.ts", "typescript", "./a.js"): ["web/a.js"], ("web/d/e.ts", "tsx", "../b"): ["web/b/index.ts"], ("web/c.ts", "typescript", "react"): [], ("web/a.ts", "typescript", "./a"): [],
        ("m.go", "go", "host/me/cmd/run"): ["cmd/run/main.go", "cmd/run/more.go"], ("m.go", "go", "fmt"): [], ("K.kt", "kotlin", "com.x.Y"): ["j/com/x/Y.java"],
        ("src/net.c", "c", "sock.h"): ["src/sock.h"], ("src/net.c", "c", "net/sock.h"): ["inc/net/sock.h"], ("src/a.rs", "rust", "crate::store::Shelf"): ["src/store/mod.rs"], ("src/a.rs", "rust", "crate"): [], ("src/a.rs", "rust", "crate::g1::m0::X"): ["src/g1/m0.rs"], ("r.rb", "ruby", "x"): [], ("r.c", "c", None): [],
    }
    got = {}
    for r in modules.module_targets(spark.createDataFrame(files, "path string, lang string"), spark.createDataFrame([*asked, *asked], "path string, lang string, module string")).collect():
        got.setdefault((r["path"], r["module"]), []).append(r["target"])
    assert {k: sorted(v) for k, v in got.items()} == {(p, m): t for (p, _, m), t in asked.items() if t}


def test_kinds_of_edges(spark):
    files = spark.createDataFrame([("t.py", True), ("u.py", True), ("a.py", False)], "path string, is_test boolean")
    edges = spark.createDataFrame([("call", "t.py", 1, "a.py", 2, 0.9), ("inherits", "t.py", 1, "a.py", 3, 0.9), ("inherits", "t.py", 1, "u.py", 4, 0.8), ("call", "a.py", None, "t.py", 1, 0.3), ("call", "gone.py", 7, "a.py", 2, 0.3)], "kind string, src_file string, src long, dst_file string, dst long, weight double")
    bound = spark.createDataFrame([("t.py", "a.py"), ("t.py", "a.py"), ("t.py", "u.py"), ("a.py", "t.py")], "path string, target string")
    got = sorted((r["kind"], r["src_file"], r["dst_file"], r["dst"] or 0, r["weight"]) for r in modules.typed_edges(edges, bound, files).collect())
    assert got == [
        ("calls", "a.py", "t.py", 1, 0.3), ("calls", "gone.py", "a.py", 2, 0.3), ("imports", "a.py", "t.py", 0, 1.0), ("imports", "t.py", "a.py", 0, 1.0), ("imports", "t.py", "u.py", 0, 1.0),
        ("inherits", "t.py", "u.py", 4, 0.8), ("tests", "t.py", "a.py", 2, 0.9), ("tests", "t.py", "a.py", 3, 0.9), ("tests_file", "t.py", "a.py", 0, 0.7),
    ]
