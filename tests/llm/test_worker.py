"""What workers hold."""

from webdistill.llm import worker


def test_one_owner_at_a_time(monkeypatch):
    given = []
    monkeypatch.setattr(worker, "_held", {})
    monkeypatch.setattr(worker, "give_back", lambda: given.append(1))
    a = worker.held("a", 1, dict)
    assert worker.held("a", 1, dict) is a and not given
    worker.held("b", 1, dict)
    assert len(given) == 1 and list(worker._held) == ["b"] and worker.held("a", 1, dict) is not a


def test_memory_is_given_back():
    worker.give_back()
