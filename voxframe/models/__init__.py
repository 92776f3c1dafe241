"""Model calls inside the dataflow: the client interface, and the checked stages around it."""
