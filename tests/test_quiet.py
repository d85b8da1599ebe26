import logging

import pytest

from tabsignal import quiet


def test_silence(capsys):
    with quiet.force_silence():
        print("hidden")
        logging.getLogger("x").error("hidden")
    print("seen")
    out = capsys.readouterr()
    assert out.out == "seen\n" and "hidden" not in out.err
    with pytest.raises(ZeroDivisionError), quiet.force_silence():
        1 / 0
    quiet.suppress_library_logs()
    assert logging.getLogger("py4j").level == logging.ERROR


def test_progress_and_report(capsys):
    assert list(quiet.maybe_progress([1, 2], False)) == list(quiet.maybe_progress([1, 2], True)) == [1, 2]
    assert "step 2" in capsys.readouterr().err
    assert quiet.readiness_text({"ready": False, "missing_columns": ["a", "b"], "n_rows": 3, "x": []}) == "not ready\n- missing_columns: a, b\n- n_rows: 3"
