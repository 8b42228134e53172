"""Sample rows of the nine entities: a first version each and, for dimensions, one with a change."""

from datetime import datetime

OPENED, ORDERED, DELIVERED, CHANGED = (
    "2023-01-02T06:00:00", "2023-02-11T13:05:00", "2023-02-11T13:40:00", "2023-03-03T18:20:10",
)


def versions(row: str, changed: str | None = None) -> list[str]:
    """The row as created, and its change later; both carry creation and modification time."""
    return [f"{row},{OPENED},{OPENED}"] + ([f"{changed},{OPENED},{CHANGED}"] if changed else [])


CSV = {
    # No anniversary, a quoted JSON text; later the login moves.
    "customer": versions(
        '7,"Koskinen, Anneli",0401112223,anneli@example.org,OTP,Female,1988-11-30,\\N,"{""diet"":""vegan"",""spice"":2}"',
        '7,"Koskinen, Anneli",0401112223,anneli@example.org,Apple,Female,1988-11-30,\\N,"{""diet"":""vegan"",""spice"":2}"',
    ),
    # No house number, coordinates joined by a pipe; later another floor.
    "customeraddress": versions(
        "70,7,C3,\\N,1st,Lake View,by the temple,Adyar,Chennai,Tamil Nadu,600020,13.0067|80.2206,N,Work",
        "70,7,C3,\\N,2nd,Lake View,by the temple,Adyar,Chennai,Tamil Nadu,600020,13.0067|80.2206,N,Work",
    ),
    "deliveryagent": versions("3,Odd Berg,0409998887,Scooter,12,Active,Male,4.25", "3,Odd Berg,0409998887,Scooter,12,Active,Male,3.9"),
    "location": versions("12,Chennai,Tamil Nadu,600001,Y", "12,Chennai,Tamil Nadu,600003,Y"),
    "restaurant": versions(
        "5,Dosa Corner,South Indian|Vegan,450,04440001,07:00-21:00,12,Y,Open,Mylapore,Tank Street 4,13.0339,80.2619",
        "5,Dosa Corner,South Indian|Vegan,450,04440001,07:00-21:00,12,Y,Closed,Mylapore,Tank Street 4,13.0339,80.2619",
    ),
    "menu": versions("50,5,Paper Dosa,thin and crisp,89.50,Breakfast,yes,Veg", "50,5,Paper Dosa,thin and crisp,94,Breakfast,yes,Veg"),
    "orders": [f"900,7,5,{ORDERED},268.50,Completed,Cash,{ORDERED},{DELIVERED}"],
    "order_item": [f"9001,900,50,3,89.50,268.50,{ORDERED},{ORDERED}"],
    "delivery": [f"90,900,3,Delivered,35 minutes,70,{DELIVERED},{ORDERED},{DELIVERED}"],
}


def ts(text: str) -> datetime:
    return datetime.fromisoformat(text)


def drop_file(folder, entity, lines) -> str:
    """Writes a landing file with a header that need not match the column names."""
    folder.mkdir(parents=True, exist_ok=True)
    name = folder / f"{entity.name}.csv"
    header = ",".join(f"col{i}" for i in range(len(entity.raw_columns)))
    name.write_text("\n".join([header, *lines]) + "\n")
    return str(folder)


def rows(df, *columns):
    """Rows as sorted tuples, in the order of ``columns``."""
    columns = columns or df.columns
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
