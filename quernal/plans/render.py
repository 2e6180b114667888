"""Results as text."""

from __future__ import annotations

LONGEST = 2000
# The tag of a fenced block by extension; others have none.
_FENCES = {"rs": "rust", "py": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "jsx", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "go": "go", "java": "java", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin", "kts": "kotlin", "sh": "shell", "bash": "shell", "zsh": "shell", "md": "markdown", "markdown": "markdown", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "html": "html", "htm": "html", "css": "css", "scss": "css", "sass": "css", "sql": "sql"}


def fence(path: str) -> str:
    name = path.rpartition("/")[2]
    return _FENCES.get(name.rpartition(".")[2].lower() if "." in name[1:] else "", "")


def truncated(content: str) -> str:
    if len(content) <= LONGEST:
        return content
    return f"{content[:LONGEST]}\n... ({LONGEST} of {len(content)} characters)"


def results(header: str, rows: list) -> str:
    out = [header, ""]
    for i, row in enumerate(rows, 1):
        shown = row["context"] if "context" in row and row["context"] is not None else truncated(row["content"])
        out += [f"## {i}. {location(row)}  [score={row['score']:.3f}]", f"```{fence(row['file_path'])}", shown.rstrip("\n"), "```", ""]
    return "\n".join(out)


def hint(query: str, mode: str) -> str:
    """What to try when a search finds nothing."""
    advice = {
        "hybrid": "Say it in other words, or look for an exact name with the bm25 mode.",
        "semantic": "Describe what you look for at more length, or look for an exact name with the bm25 mode.",
        "bm25": "Write the name just as the code has it, or search by meaning too with the hybrid mode.",
    }
    return f'Nothing found for "{query}" in mode {mode}. {advice[mode]}'


def location(row: dict) -> str:
    return f"{row['file_path']}:{row['start_line']}-{row['end_line']}"


def symbols(name: str, rows: list) -> str:
    """What is known of a name: places, with the chunks they are in where rows have their ``content``."""
    out = [f"# {name}"]
    for role, title in (("def", "Defined at"), ("ref", "Referenced at")):
        own = [r for r in rows if r["role"] == role]
        if own:
            out.append(f"## {title}")
        for r in sorted(own, key=lambda r: (r["file_path"], r["line"])):
            out.append(f"- {r['file_path']}:{r['line']} ({'symbol' if r['kind'] == 'unknown' else r['kind']})")
            if "content" in r:
                out += [f"```{fence(r['file_path'])}", truncated(r["content"].strip()), "```"]
    return "\n".join(out)


def human_size(n: int) -> str:
    size = float(n)
    for unit in ("B", "KiB", "MiB", "GiB"):
        if size < 1024 or unit == "GiB":
            return f"{n} B" if unit == "B" else f"{size:.2f} {unit}"
        size /= 1024
    return ""
