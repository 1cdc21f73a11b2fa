"""``python -m flowlattice``."""

import sys

from flowlattice.cli import main

sys.exit(main())
