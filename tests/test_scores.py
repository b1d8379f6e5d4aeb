"""Scores are found once."""

from trustwatch.plans import q_detect as QD


def test_scores_are_written_as_they_come(monkeypatch):
    """An order would be sampled first, and that scores every row once more."""
    seen = {}
    monkeypatch.setattr(QD.V, "staged", lambda spark, sf, name, build, order: seen.setdefault(name, order))
    QD.score_table(None, "")
    QD.fold_scores(None, "")
    assert seen == {"scores": [], "fold_scores": []}
