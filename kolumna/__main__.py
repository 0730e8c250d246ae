import sys

from kolumna.cli import main

sys.exit(main())
