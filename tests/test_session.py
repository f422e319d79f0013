"""The package reaches executors that cannot find it by path."""

from __future__ import annotations

import os
import subprocess
import sys
import textwrap

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_workers_get_the_package_from_any_folder(tmp_path):
    """A session started elsewhere, with the package on the driver's path alone, runs a function of it in Python workers."""
    code = f"""
    import sys
    sys.path.insert(0, {ROOT!r})
    from hourmark.session import build_session, ship_package

    spark = build_session("elsewhere", "local[2]", **{{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}})
    ship_package(spark)
    ship_package(spark)

    def run(batches):
        from hourmark.session import RUNTIME_CONF

        for batch in batches:
            assert RUNTIME_CONF
            yield batch

    print("rows", spark.range(5).mapInArrow(run, "id bigint").count())
    spark.stop()
    """
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "rows 5" in done.stdout, done.stderr[-2000:]
