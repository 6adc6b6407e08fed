"""What kind of text a path holds: which rules and which comment syntax apply to it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.views import suffix

HASH = ".bash .cfg .conf .ebuild .eclass .fish .ini .ksh .mk .pl .properties .r .rb .sh .toml .yaml .yml .zsh".split()
HASH_NAMES = "BUILD CMakeLists.txt Containerfile Dockerfile Gemfile GNUmakefile Justfile Makefile PKGBUILD Rakefile Vagrantfile".split()
SLASH = ".c .cc .cjs .cpp .cs .cxx .dart .go .h .hpp .java .js .jsx .kt .kts .m .mjs .mm .mts .php .rs .scala .scss .swift .ts .tsx .vue".split()
MARKUP = ".htm .html .markdown .md .mdx .svelte .svg .vue .xhtml .xml".split()
DATA = ".csv .json .jsonl .toml .tsv .yaml .yml".split()
PROSE = ".adoc .markdown .md .mdx .org .rst .tex .txt".split()
SHELL = ".bash .ebuild .eclass .fish .ksh .sh .zsh".split()
TEMPLATES = ".cjs .js .jsx .mjs .mts .ts .tsx".split()
MARKDOWN = [".md", ".markdown", ".mdx"]
SURFACES = ".htm .html .jsx .mdx .svelte .tsx .vue".split()
SKIPPED_FOLDERS = ".git .hg .svn node_modules vendor __pycache__".split()
KNOWN = sorted({*HASH, *SLASH, *MARKUP, *DATA, *PROSE, ".css", ".lua", ".py", ".pyi", ".sql"})


def name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def known(path: Column) -> Column:
    """Whether the name alone tells that a file is text."""
    return suffix(path).isin(KNOWN) | name(path).isin(HASH_NAMES)


def is_prose(path: Column, text: Column) -> Column:
    """Prose and data by their suffix, and files without one that are no scripts."""
    s = suffix(path)
    return s.isin([*PROSE, *DATA]) | ((s == "") & ~text.startswith("#!"))
