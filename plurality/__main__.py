import sys

from plurality.cli import main

sys.exit(main())
