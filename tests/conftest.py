from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"

GIF, XML, DIV, RUN = b"GIF89a\x00", b"<a><b></a>", b"7/0\n", b"\xff" * 33
#: two workers of one campaign: 6 crash inputs, 4 contents, one of them three times
CRASHES = {
    "gifdec": {"id_000000,sig_11,time_120,op_flip1": GIF,
               "id_000001,sig_06,time_410,op_splice": XML,
               "id_000002,sig_11,time_999,op_arith8": GIF},
    "gifdec 2": {"id_000000,sig_08,time_77,op_int16": DIV,
                 "id_000001,sig_11,time_500,op_flip2": GIF,
                 "id_000002,sig_07,time_640,op_quick": RUN},
}
STATS = {
    "gifdec": {"start_time": 1690000100, "last_update": 1690007300, "execs_done": 987001, "execs_per_sec": 311.25,
               "corpus_count": 77, "saved_crashes": 3, "saved_hangs": 1, "afl_version": "4.30a",
               "command_line": "afl-fuzz -m none -i seeds -o sync -- /opt/bin/gifdec --fast"},
    # the keys of older versions
    "gifdec 2": {"execs_done": 40, "execs_per_sec": 1.5, "paths_total": 12, "unique_crashes": 3,
                 "fuzzer_version": "2.57b", "target_mode": "qemu"},
}
#: (time, crashes) of each point
PLOT = [(1690000100, 0), (1690001900, 1), (1690003700, 1), (1690007300, 3)]


@pytest.fixture(scope="session")
def spark():
    from crashlake.session import local_session

    s = local_session(cores="*", shuffle_partitions=8, app="crashlake-tests")
    yield s


@pytest.fixture
def campaign(tmp_path):
    """A fuzzer output tree of two workers; a queue folder that itself holds a `crashes` folder is no crash."""
    root = tmp_path / "sync"
    for worker, crashes in CRASHES.items():
        folder = root / worker / "crashes"
        folder.mkdir(parents=True)
        for name, body in crashes.items():
            (folder / name).write_bytes(body)
        stats = "".join(f"{k:<18}: {v}\n" for k, v in STATS[worker].items())
        (root / worker / "fuzzer_stats").write_text(stats)
    (root / "gifdec" / "crashes" / "README.md").write_text("how to replay these inputs")
    nested = root / "gifdec" / "queue" / "crashes"
    nested.mkdir(parents=True)
    (nested / "id_000099,sig_11").write_bytes(GIF)
    points = "".join(f"{t}, 0, 0, 0, 0, 0, 0.5%, {n}, 0\n" for t, n in PLOT)
    (root / "gifdec" / "plot_data").write_text(f"# time and counters\n{points}1690009999, 1, 2\n\n")
    return root
