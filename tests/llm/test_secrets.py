"""Keys anywhere in long runs, and beside base findings."""

import numpy as np

from contactloom.llm import secret_scan

KEY = "q7ZrT2mXw9LcVb4KfYh8NsPd3GjUe6RaQ1oWiEtM"


def _scored(text):
    return [(a, b) for kind, a, b, _ in secret_scan.scan(text, secret_scan.trained())[1] if kind == "scored"]


def test_windows_cover_every_character():
    for n in (16, 63, 64, 65, 96, 97, 128, 200, 1000):
        cut = secret_scan.pieces(5, 5 + n)
        assert set().union(*(range(a, b) for a, b in cut)) == set(range(5, 5 + n)) and all(b - a == min(n, 64) for a, b in cut)
    x, size = secret_scan.window("k" * 64 + "!" * 40, 0, 64)
    assert size == 64 and (x[96:] == secret_scan.CLASS[ord("!")]).all()


def test_keys_at_the_end_of_long_runs():
    path = "/".join(["station", "morning", "caution", "prelystation", "forthean", "ontheing", "constaon", "reading", "tioned"])
    for lead in (path + "/", "-" * 90, "=" * 200, "_" * 70 + path + "/"):
        assert _scored(f"see {lead}{KEY} there") == [(4, 4 + len(lead) + len(KEY))], lead
    assert _scored(f"see {path} there") == [] and _scored("-" * 200) == []


def test_parts_beside_base_findings():
    text = f"see build/0123456789abcdef/{KEY} there"
    at = text.index("/" + KEY)
    assert _scored(text) == [(at, at + 1 + len(KEY))]
    assert _scored("see build/0123456789abcdef/short there") == []


def test_long_findings_kept_apart():
    net, found = secret_scan.trained(), secret_scan.long_findings(400, 9)
    score, y = secret_scan.scores(net, [f[:3] for f in found]), np.array([f[3] for f in found])
    print("long: recall", (score[y == 1] >= net.threshold).mean(), "alarms", (score[y == 0] >= net.threshold).mean())
    assert (score[y == 1] >= net.threshold).mean() > 0.95 and (score[y == 0] >= net.threshold).mean() < 0.05
