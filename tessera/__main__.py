from .plans.pipeline import main

raise SystemExit(main())
