"""What a program leaves in the shared folder."""

import os
import subprocess
import sys
import time

PROGRAM = """
import os
import sys
from pyspark.sql import SparkSession
from tierlake.shared import Rounds
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
space = Rounds(spark, "trial")
one = space.keep(spark.range(5))
two = space.keep(one.where("id > 2"))
space.drop(one)
assert two.count() == 2 and len(os.listdir(space.root)) == 1
if sys.argv[2] == "stop":
    spark.stop()
"""


def test_rounds_go_with_their_program(tmp_path):
    for how in ("stop", "end"):
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        subprocess.run([sys.executable, "-c", PROGRAM, str(tmp_path), how], check=True, env=os.environ | {"PYTHONPATH": root}, capture_output=True, timeout=200)
        # the JVM may end a moment after the program
        for _ in range(100):
            left = [n for n in os.listdir(tmp_path) if n.startswith("trial-")]  # Spark has a folder of its own there
            if not left:
                break
            time.sleep(0.2)
        assert left == []
