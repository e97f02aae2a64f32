import sys

from pollveil.cli import main

sys.exit(main())
