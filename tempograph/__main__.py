from .cli import main

main().show(100, truncate=False)
