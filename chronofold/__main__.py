import sys

from chronofold.cli import main

sys.exit(main())
