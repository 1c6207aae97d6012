from types import SimpleNamespace

from driftwood.llm import binary_ids
from driftwood.llm.encode import public_path


def test_tasks_that_write_and_read_ids_give_memory_back(monkeypatch):
    calls = []
    monkeypatch.setattr(binary_ids.X, "give_back", lambda: calls.append(1))
    monkeypatch.setattr(binary_ids, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    assert list(binary_ids._write(public_path("byte_bpe_50k.json"), 0, 10, 1)(iter([]))) == [] and len(calls) == 1
    assert list(binary_ids._read(iter([]))) == [] and len(calls) == 2
