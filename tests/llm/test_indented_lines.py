"""Indented lines of messages: natural language is read, paths and code aren't."""

from boughline.llm.language import sentences


def words(text):
    return [[ws for _, ws in p] for p in sentences(text)]


def test_indented_natural_language_is_read():
    text = "commit 12ab\n\n    - The first point goes on\n      to the next line of\n      text.\n\n      Ein Absatz weiter innen.\n\n      次の段落です。\n"
    got = words(text)
    assert got[0] == [["the", "first", "point", "goes", "on", "to", "the", "next", "line", "of", "text"]]
    assert got[1] == [["ein", "absatz", "weiter", "innen"]] and len(got) == 3
    assert words("One line\n  goes on here.") == [[["one", "line", "goes", "on", "here"]]]


def test_indented_paths_and_code_are_left_out():
    text = "commit 12ab\n\n    Read it.\n\n    Conflicts:\n            src/x.c\n    \tMakefile\n      src/a.c | 12 ++--\n      M src/b.c\n      int x = f(a, b);\n"
    assert words(text) == [[["read", "it"]]]
