from paperloom.cli import main

raise SystemExit(main())
