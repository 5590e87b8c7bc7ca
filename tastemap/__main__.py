import sys

from tastemap.plans.cli import main

sys.exit(main())
