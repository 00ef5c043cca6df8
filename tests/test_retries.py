"""Task retries (as after a lost executor) do not change any pseudonym."""

import json
import os
import subprocess
import sys

from conftest import SF_SMALL


def test_retried_tasks_give_the_same_output():
    script = os.path.join(os.path.dirname(os.path.abspath(__file__)), "retry_run.py")
    out = subprocess.run([sys.executable, script, SF_SMALL], capture_output=True, text=True, timeout=900)
    last = [line for line in out.stdout.splitlines() if line.startswith("{")]
    assert last, out.stderr[-2000:]
    res = json.loads(last[-1])
    assert res["failures"] >= 1  # the failure was injected and retried
    assert res["equal"] and res["rows"] > 0
