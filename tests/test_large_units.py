"""Units of many kilobytes are cut at their members."""

import time

import pytest

from quernal.operators import structure

BODY = "\n".join(f"        x = x + {j};" for j in range(20))
METHODS = {
    "java": ("public class Big {\n", lambda i: f"    public int method{i}(int x) {{\n{BODY}\n        return x;\n    }}\n\n", "}\n"),
    "typescript": ("export class Big {\n", lambda i: f"    method{i}(x: number) {{\n{BODY}\n        return x;\n    }}\n\n", "}\n"),
    "cpp": ("class Big {\npublic:\n", lambda i: f"    int method{i}(int x) {{\n{BODY}\n        return x;\n    }}\n\n", "};\n"),
    "rust": ("mod big {\nimpl Big {\n", lambda i: f"    fn method{i}(x: i32) -> i32 {{\n{BODY}\n        x\n    }}\n\n", "}\n}\n"),
    "python": ("class Big:\n", lambda i: f"    @fixed\n    def method{i}(self, x):\n{BODY}\n        return 'é'\n\n", ""),
    "ruby": ("module Outer\n  class Big\n", lambda i: f"    def method{i}(x)\n{BODY}\n      x\n    end\n\n", "  end\nend\n"),
}


@pytest.mark.parametrize("language", METHODS)
def test_cut_at_members(language):
    head, member, tail = METHODS[language]
    source = head + "".join(member(i) for i in range(40)) + tail
    chunks = structure.chunks(source, language)
    assert len(source) > 15_000 and len(chunks) > 5
    assert all(c["end_byte"] - c["start_byte"] <= structure.LARGEST for c in chunks)
    assert "".join(c["content"] for c in chunks).split() == source.split()
    assert all(c["start_byte"] == 0 or source.encode()[c["start_byte"] - 1 :].startswith(b"\n") or not c["content"][0].isspace() for c in chunks)
    # no member is torn
    assert all(any(member(i).strip() in c["content"] for c in chunks) for i in range(40))


def test_one_large_member():
    source = "class A {\n    void f() {\n" + "        step(1, 2);\n" * 400 + "    }\n}\n"
    chunks = structure.chunks(source, "java")
    assert all(c["end_byte"] - c["start_byte"] <= structure.LARGEST for c in chunks) and len(chunks) > 2
    assert "".join(c["content"] for c in chunks).split() == source.split()


def test_no_members_stay_whole():
    source = "x = '''" + "long text\n" * 600 + "'''\n"
    assert [c["content"] for c in structure.chunks(source, "python")] == [source]


@pytest.mark.parametrize(
    ("language", "source"),
    [
        ("json", '{\n  "items": [\n' + ",\n".join(f'    {{"id": {i}, "name": "a {{ b", "text": "{"x" * 80}"}}' for i in range(200)) + "\n  ]\n}\n"),
        ("yaml", "items:\n" + "".join(f"  - id: {i}\n    text: {'x' * 80}\n" for i in range(200))),
        ("markdown", "# list\n\n" + "".join(f"- item {i} {'x' * 80}\n  goes on\n" for i in range(200))),
        ("c", "void f(void)\n{\n" + "    if (x) {\n        step(1, 2);\n    } else {\n        step(2, 1);\n    }\n" * 200 + "}\n"),
        ("javascript", "const all = {\n" + "".join(f"  f{i}: function () {{\n    return '{'x' * 80}';\n  }},\n" for i in range(100)) + "};\n"),
    ],
)
def test_other_languages(language, source):
    chunks = structure.chunks(source, language)
    assert len(source) > 2 * structure.LARGEST and all(c["end_byte"] - c["start_byte"] <= structure.LARGEST for c in chunks)
    assert "".join(c["content"] for c in chunks).split() == source.split()


def test_lines_are_counted_in_linear_time():
    source = "".join(f"int f{i}(int x)\n{{\n    return x;\n}}\n" for i in range(60_000))
    began = time.time()
    chunks = structure.chunks(source, "c")
    assert time.time() - began < 20
    assert all(c["start_line"] == 1 + source.count("\n", 0, c["start_byte"]) for c in chunks[:: len(chunks) // 50])
    assert [d["line"] for c in chunks for d in c["symbols"]] == list(range(1, 240_001, 4))
