import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

#: Tests of both folders may run together, and those above take this from whichever conftest was read last.
SF = "/root/testdata/sf0.001"
