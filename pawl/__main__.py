"""`python -m pawl`."""

import sys

from pawl.cli import main

sys.exit(main())
