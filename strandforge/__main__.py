import sys

from strandforge.cli import main

sys.exit(main())
