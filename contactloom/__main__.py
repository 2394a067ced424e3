from contactloom.commands import main

main()
