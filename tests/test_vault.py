"""Markdown folders: frontmatter, sections and admission."""

import os

import pytest

from corkboard.functions import markdown
from corkboard.sources import vault


@pytest.mark.parametrize(
    ("text", "values", "error"),
    [
        ("a: b # note\nc: 'x # y'", {"a": ["b"], "c": ["x # y"]}, None),
        ("tags: [one, 'two, three']\nTags: four", {"tags": ["one", "two, three", "four"]}, None),
        ("tags:\n  - one # first\n  - two", {"tags": ["one", "two"]}, None),
        ("a: null\nb: TRUE", {"a": [None], "b": ["true"]}, None),
        ("a: >\n  folded", {"a": [">"]}, "unsupported_frontmatter_value"),
        ("a: [b, [c]]", {"a": ["[b, [c]]"]}, "unsupported_frontmatter_value"),
        ("a:\n  - b: c", {"a": ["b: c"]}, "unsupported_frontmatter_value"),
        ("plain", {}, "unsupported_frontmatter_syntax"),
        ("b c: d", {}, "invalid_frontmatter_key"),
    ],
)
def test_frontmatter(text, values, error):
    found, start, valid, told = markdown.frontmatter(["---", *text.split("\n"), "---", "body"])
    assert (found, told, valid) == (values, error, error is None)
    assert start == len(text.split("\n")) + 2


def test_frontmatter_ends():
    assert markdown.frontmatter(["---", "a: b"]) == ({}, 0, False, "unterminated_frontmatter")
    assert markdown.frontmatter(["---", *["a: b"] * 500, "---"])[3] == "frontmatter_too_many_lines"
    assert markdown.frontmatter(["---", *[f"k{i}: v" for i in range(499)], "---"])[2]
    assert markdown.frontmatter(["text"]) == ({}, 0, True, None)


def test_sections():
    lines = ["before", "# One", "", "x", "", "```", "# not one", "~~~", "```", "## Two", "# Three", "y"]
    heads = markdown.headings(lines, 0)
    assert [(at, level, t) for at, level, t in heads] == [(1, 1, "One"), (9, 2, "Two"), (10, 1, "Three")]
    assert [s[:3] for s in markdown.sections(lines, 0, heads)] == [("Overview", 1, 1), ("One", 4, 9), ("Three", 12, 12)]
    assert markdown.sections(["", " "], 0, []) == []
    assert markdown.sections(["# A"], 0, [(0, 1, "A")]) == []


def test_policy():
    with pytest.raises(ValueError, match="unknown"):
        vault.Policy.from_json('{"other": 1}')
    for bad in ('{"max_file_bytes": true}', '{"include_paths": "a"}', '{"deny_frontmatter": {"a": 1}}', "[]"):
        with pytest.raises(ValueError):
            vault.Policy.from_json(bad)


def test_folder(spark, tmp_path):
    def put(path, content):
        to = tmp_path / path
        to.parent.mkdir(parents=True, exist_ok=True)
        to.write_bytes(content if isinstance(content, bytes) else content.encode())

    put("a.md", "# Heading\r\n\r\nfirst\u2028line\r\nlast\r\n")
    put("deep/er/down/B.MD", "---\ntitle: Own\ntags: [x]\n---\ntext")
    put("deep/sealed.md", "---\nsensitivity: open, 'Sealed'\nsensitivity: sealed\n---\ntext")
    put("deep/odd.md", "---\na: |\n---\ntext")
    put("utf16.md", "\ufefftext".encode("utf-16-le"))
    put("large.md", "x" * 300)
    put("drafts/c.md", "c")
    put("private plan.md", "c")
    put(".git/d.md", "d")
    put("other.txt", "e")
    put("linked.md", "f")
    os.link(tmp_path / "linked.md", tmp_path / "twin.md")
    os.symlink(tmp_path / "a.md", tmp_path / "soft.md")
    policy = vault.Policy(exclude_globs=["draft?/*"], deny_path_terms=["Private"], deny_frontmatter={"Sensitivity": ["SEALED"]}, max_file_bytes=200)
    read = vault.admitted(vault.files(spark, str(tmp_path), policy), policy)
    rows = {r.relative_path: r for r in read.collect()}
    reasons = {p: r.skip_reason for p, r in rows.items()}
    assert reasons == {
        "a.md": None, "deep/er/down/B.MD": None, "deep/sealed.md": "denied_frontmatter:sensitivity", "deep/odd.md": "unparseable_frontmatter", "utf16.md": "unsupported_encoding",
        "large.md": "file_too_large", "drafts/c.md": "excluded_glob", "private plan.md": "denied_path_term", "linked.md": "hardlink", "twin.md": "hardlink", "soft.md": "symlink",
    }
    assert rows["deep/er/down/B.MD"].title == "Own" and rows["a.md"].title == "Heading"
    assert [(s.relative_path, s.line_start, s.line_end) for s in vault.sections(read).orderBy("relative_path").collect()] == [("a.md", 3, 4), ("deep/er/down/B.MD", 5, 5)]
    assert {r.skip_reason: r.files for r in vault.skips(read).collect()}["hardlink"] == 2


def test_anywhere(spark, tmp_path):
    """The same rows as the folder source gives of ordinary files, whatever the file system; large contents stay unread."""
    for name, text in {"A b.md": "# A", "x/y/z/C.MD": "c", "x/.git/no.md": "n", "x/big.md": "b" * 500, "other.txt": "t"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    policy = vault.Policy(max_file_bytes=100)
    rows = {r.relative_path: r for r in vault.anywhere(spark, f"file://{tmp_path}", policy).collect()}
    walked = {r.relative_path: r for r in vault.files(spark, str(tmp_path), policy).collect()}
    assert set(rows) == set(walked) == {"A b.md", "x/y/z/C.MD", "x/big.md"}
    assert all((r.size, r.content) == (walked[p].size, walked[p].content) and abs(r.mtime_ns - walked[p].mtime_ns) < 1_000_000_000 for p, r in rows.items())
    assert {r.relative_path: r.skip_reason for r in vault.admitted(vault.anywhere(spark, str(tmp_path), policy), policy).collect()} == {"A b.md": None, "x/y/z/C.MD": None, "x/big.md": "file_too_large"}
