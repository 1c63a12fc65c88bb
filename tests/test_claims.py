import re
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def claimed(text):
    """Ids in a text, with ranges like D1-D20 written out."""
    out = set()
    for kind, first, last in re.findall(r"\b([A-L])(\d+)(?:[-\u2013][A-L](\d+))?\b", text):
        out |= {f"{kind}{i}" for i in range(int(first), int(last or first) + 1)}
    return out


def test_ids_listed_as_not_built_are_claimed_nowhere():
    readme = (ROOT / "README.md").read_text()
    missing = claimed(re.search(r"\*\*Not built:\*\*(.*?)L5 returns", readme, re.S)[1])
    assert missing == set()
    layout = readme.split("## Layout")[1].split("## Running")[0]
    modules = [p.read_text().split('"""')[1] for p in (ROOT / "tractlens" / "operators").glob("*.py")]
    assert not missing & claimed(" ".join([layout, *modules]))
