import sys

from tidefold.cli import main

sys.exit(main())
