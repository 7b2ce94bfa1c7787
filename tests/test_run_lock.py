"""The lock of a run: one holder, stale holders replaced."""

import os
import subprocess
import sys

import pytest

from factloom.sources.snapshots import run_lock


def test_one_run_at_a_time(tmp_path):
    path = str(tmp_path / "run.lock")
    with run_lock(path):
        with pytest.raises(RuntimeError, match=str(os.getpid())), run_lock(path):
            pass
        assert os.path.exists(path)
    assert not os.path.exists(path)


def test_a_lock_of_an_ended_process_is_taken_over(tmp_path):
    path = tmp_path / "run.lock"
    ended = subprocess.run([sys.executable, "-c", "import os; print(os.getpid())"], capture_output=True, text=True, check=True).stdout.strip()
    path.write_text(ended)
    with run_lock(str(path)):
        assert path.read_text() == str(os.getpid())
    assert not path.exists()


def test_a_file_that_names_nobody_is_left_alone(tmp_path):
    path = tmp_path / "run.lock"
    path.write_text("")
    with pytest.raises(RuntimeError, match="unknown"), run_lock(str(path)):
        pass
    assert path.exists()
